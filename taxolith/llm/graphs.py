"""Connected components of a link table, as a few joins on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node of links (a, b).

    Each round hangs the larger neighbours of every node, then the smaller ones, on the least of them; rounds go on
    until the links are stars. A link (x, x) does no harm. A node with many neighbours has them dealt to several tasks.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = common.written(edges, "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = common.spread_join(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            both.where("a = b").select("a", "b")
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = common.spread_join(large, low, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").distinct()
        old, edges = edges, common.written(small, "links")
        common.discard(old)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def tops(links: DataFrame) -> DataFrame:
    """(node, root) for a forest: links (a, b) with one row a node a at most, and no circles. Every node that is in a link
    gets its tree's top, by jumping twice as far in each round."""
    table = common.written(links.select(F.col("a").alias("node"), F.col("b").alias("up")), "up")
    while True:
        up = table.select("node", "up")
        far = common.spread_join(up, up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up", "node")
        old, table = table, common.written(far.select("node", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "up")
        common.discard(old)
        if table.where("moved").isEmpty():
            found = table.select("node", F.col("up").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
