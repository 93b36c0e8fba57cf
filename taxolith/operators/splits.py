"""Splits, folds and fingerprints that do not depend on the order or the partitions of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxolith.functions import text as T


def id_hash_fold(df: DataFrame, id_col: str, n: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """The fold of a key: the first 8 bytes of SHA-1(seed|key), modulo n. Blank keys have none and raise."""
    if n < 2:
        raise ValueError("at least two folds are needed")
    key = T.strip(F.col(id_col).cast("string"))
    place = head(F.concat(F.lit(f"{seed}|"), key)) % n
    fold = F.when(key.isNull() | (key == ""), F.raise_error(F.lit("a blank key has no fold")).cast("int")).otherwise(place.cast("int"))
    return df.withColumn(out, fold)


def stratified_fold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 0, out: str = "fold") -> DataFrame:
    """Folds dealt in turn within each class, in the order of a hash of the key."""
    return ranked(df, label, key, seed).withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_size")


def ranked(df: DataFrame, label: str, key: str, seed: int, bits: int = 12) -> DataFrame:
    """df with _rank, the place of a row among those of its label by the hash of its key, from 1, and _size, their number.

    A label may have a large share of the rows, so none is sorted as a whole: the hash's first bits cut it into ranges,
    whose rows are counted, and a row's place is that in its range after the rows of the ranges before."""
    place = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.withColumns({"_label": F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")), "_place": place, "_range": F.shiftright(place, 64 - bits).cast("int")})
    counts = rows.groupBy("_label", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("_label").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_label", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy("_label")).alias("_size"))
    own = W.partitionBy("_label", "_range").orderBy("_place", F.col(key))
    out = rows.withColumn("_own", F.row_number().over(own)).join(starts, ["_label", "_range"])
    return out.withColumn("_rank", F.col("_before") + F.col("_own")).drop("_label", "_place", "_range", "_own", "_before")


def split(df: DataFrame, key: str, label: str | None = None, share: float = 0.1, seed: int = 42, lone_to_train: bool = False) -> tuple[DataFrame, DataFrame]:
    """(train, held out). With a label the share is held out of every class; classes of one row raise, or go to the
    training rows whole. Without, rows are held out by the hash of their key, without a shuffle."""
    if label is None:
        marked = df.withColumn("_held", F.coalesce(head(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))) % 1_000_000 < int(share * 1_000_000), F.lit(False)))
    else:
        lone = F.lit(0) if lone_to_train else F.raise_error(F.concat(F.lit("a class has one row: "), F.col(label).cast("string"))).cast("int")
        many = F.when(F.col("_size") == 1, lone).otherwise(F.greatest(F.lit(1), F.round(F.col("_size") * share)).cast("int"))
        marked = ranked(df, label, key, seed).withColumn("_held", F.col("_rank") <= many).drop("_rank", "_size")
    return marked.where(~F.col("_held")).drop("_held"), marked.where("_held").drop("_held")


def data_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, and a sum modulo 2^64 of the first 8 bytes of each row's SHA-1, the same in any order. A row is its
    columns' values as text, each behind its length; a null is a hyphen."""
    parts = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    whole = F.coalesce(F.sum(head(F.concat(*parts)).cast("decimal(38,0)")), F.lit(0)) % F.lit(str(1 << 64)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), whole.cast("string").alias("fingerprint"))


def head(text: Column) -> Column:
    """The first 8 bytes of a text's SHA-1, as a number."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def id_fingerprint(ids: DataFrame, column: str = "id") -> DataFrame:
    """The same for a set of ids: repeats do not count."""
    return data_fingerprint(ids.select(T.strip(F.col(column).cast("string")).alias("id")).distinct(), ["id"])
