"""Row filters and row-level validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import text as T


def check_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Fail while planning if a column is absent."""
    if gone := [c for c in needed if c not in df.columns]:
        raise ValueError(f"columns {gone} are not among {df.columns}")
    return df


def labelled(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~T.strip(F.col(c).cast("string")).isin("", "nan", "None") for c in columns))


def drop_null_rows(df: DataFrame, text_col: str | None, levels: Sequence[str] = ()) -> DataFrame:
    """Without rows of blank text, or of a label that is null or a stringified null."""
    out = df.where(F.col(text_col).isNotNull() & (T.strip(F.col(text_col)) != "")) if text_col else df
    return out.where(labelled(levels)) if levels else out


def blank_out_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: T.blank_nulls(F.col(c)) for c in columns})


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n: how many values blank_out_nulls changes."""
    counts = df.agg(*[F.count_if(F.col(c).isNull() | F.lower(T.strip(F.col(c))).isin(*T.NULL_STRINGS)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")


def drop_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Without the rows whose key, as stripped text, is in ids(id)."""
    listed = ids.select(T.strip(F.col("id").cast("string")).alias("_id")).distinct()
    return df.withColumn("_id", T.strip(F.col(id_col).cast("string"))).join(listed, "_id", "left_anti").drop("_id")


def scoped(train: DataFrame, held: DataFrame, ids: DataFrame, id_col: str, scope: str = "train") -> tuple[DataFrame, DataFrame]:
    """Both splits without the listed keys: of the training rows only ("train"), or of all rows ("all")."""
    if scope not in ("train", "all"):
        raise ValueError(f"no scope {scope!r}: train or all")
    return drop_ids(train, ids, id_col), drop_ids(held, ids, id_col) if scope == "all" else held


def drop_report(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """One row: rows removed, ids that match some row, ids that match none."""
    listed = ids.select(T.strip(F.col("id").cast("string")).alias("_id")).distinct()
    rows = df.groupBy(T.strip(F.col(id_col).cast("string")).alias("_id")).agg(F.count("*").alias("n"))
    return listed.join(rows, "_id", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("removed_rows"), F.count("n").alias("matched_ids"), F.count_if(F.col("n").isNull()).alias("unmatched_ids"))


def drop_rare_classes(df: DataFrame, label: str, least: int = 6) -> DataFrame:
    """Rows whose class has enough rows; null labels go unless everything stays."""
    if least <= 1:
        return df
    kept = df.where(F.col(label).isNotNull()).groupBy(label).count().where(F.col("count") >= least).select(label)
    return df.join(kept, label, "left_semi")


def drop_rare_paths(df: DataFrame, levels: Sequence[str], least: int = 2) -> DataFrame:
    """Rows whose whole path has enough rows; null is a value like any other here. Counts are summed before they are
    joined back, so a path with a third of all rows is no hot task."""
    key = F.sha2(F.to_json(F.struct(*levels), {"ignoreNullFields": "false"}), 256)
    kept = df.groupBy(key.alias("_path")).count().where(F.col("count") >= least).select("_path")
    return df.withColumn("_path", key).join(kept, "_path", "left_semi").drop("_path")


def prepared(df: DataFrame, text_col: str, levels: Sequence[str], class_rows: int = 6, path_rows: int = 2) -> DataFrame:
    """Null rows, then rare classes, then rare paths."""
    return drop_rare_paths(drop_rare_classes(drop_null_rows(df, text_col, levels), levels[-1], class_rows), levels, path_rows)


def duplicate_ids(df: DataFrame, id_col: str) -> DataFrame:
    key = T.strip(F.col(id_col).cast("string"))
    return df.agg((F.count("*") - F.count_distinct(key)).alias("n_duplicates"))


def marker_report(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Rows whose text holds a token with the prefix, and distinct tokens."""
    token = F.regexp_extract(F.col(text_col), rf"(?:^|\s)({T.quoted(prefix)}\S+)", 1)
    return df.agg(F.avg((token != "").cast("int")).alias("present"), F.count_distinct(F.when(token != "", token)).alias("n_distinct"))


def path_lookup(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, those whose key has the least hash: the same ones whatever the partitions."""
    return df.orderBy(F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def with_group_size(df: DataFrame, columns: Sequence[str], name: str = "group_size") -> DataFrame:
    """Every row with the number of rows that have its values; counts are summed before they are joined back."""
    key = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    keyed = df.withColumn("_group", key)
    return keyed.join(keyed.groupBy("_group").agg(F.count("*").alias(name)), "_group").drop("_group")
