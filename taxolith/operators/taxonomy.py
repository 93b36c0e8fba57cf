"""The catalogue's joins: items, warehouses, the category tree, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_items(sku: DataFrame, item: DataFrame, warehouse: DataFrame, companies: Sequence[int] = (1, 55)) -> DataFrame:
    """Items of the product numbers in sku that are current and of these companies, with their warehouse row if any.

    The warehouse's own conditions belong to the join, not to the filter after it: an item without a row stays."""
    base = sku.join(item, "product_no").where((F.col("current") == 1) & F.col("cono").isin(*companies) & F.col("product_no").isNotNull())
    own = warehouse.where(F.col("warehouse_current") == 1)
    return base.join(own, ["product_no", "cono"], "left")


def level_columns(nodes: DataFrame, depth: int, keep_names: bool = True) -> DataFrame:
    """An adjacency list (id, parent_id, level, name, current) as one row a path: l1_id .. ln_id and names.

    Each deeper level is a left join, so short branches stay."""
    now = nodes.where(F.col("current") == 1)
    out = None
    for k in range(1, depth + 1):
        own = now.where(F.col("level") == k).select(F.col("id").alias(f"l{k}_id"), F.col("name").alias(f"l{k}_name"), F.col("parent_id").alias("_p"))
        out = own.drop("_p") if out is None else out.join(own, out[f"l{k - 1}_id"] == own["_p"], "left").drop("_p")
    return out if keep_names else out.select(*[f"l{k}_id" for k in range(1, depth + 1)])


def with_tree(base: DataFrame, tree: DataFrame, leaf: str, tree_leaf: str) -> DataFrame:
    """Rows whose leaf is in the tree, with its columns."""
    return base.where(F.col(leaf).isNotNull()).join(tree, base[leaf] == tree[tree_leaf])


def attach_names(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Names by the whole path; one name row a path, so no row is doubled."""
    single = lookup.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_n")).select(*keys, *[F.col(f"_n.{n}").alias(n) for n in names])
    return rows.join(single, list(keys), "left")
