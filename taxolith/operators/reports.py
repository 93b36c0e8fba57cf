"""Small report tables over a catalogue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_distribution(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, n_classes, min_rows, median_rows, max_rows, under_10: one aggregation for all levels."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("label")) for c in levels])).alias("x")).select("x.*").where("label is not null")
    return long.groupBy("level", "label").count().groupBy("level").agg(
        F.count("*").alias("n_classes"), F.min("count").alias("min_rows"), F.percentile("count", F.lit(0.5)).alias("median_rows"), F.max("count").alias("max_rows"), F.count_if(F.col("count") < 10).alias("under_10"))


def distribution_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """class_distribution before and after, side by side."""
    names = [c for c in before.columns if c != "level"]
    return before.withColumnsRenamed({c: f"{c}_before" for c in names}).join(after.withColumnsRenamed({c: f"{c}_after" for c in names}), "level")


def column_usefulness(df: DataFrame, columns: Sequence[str], label: str, rows: int = 50) -> DataFrame:
    """column, present, n_distinct, rows_per_value, median_categories and rows_covered of values with enough rows."""
    long = df.select(F.col(label).alias("_l"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("_l", "x.*")
    pairs = long.groupBy("column", "value", "_l").agg(F.count("*").alias("n"))
    values = pairs.groupBy("column", "value").agg(F.sum("n").alias("n"), F.count("_l").alias("categories"))
    there = F.col("value").isNotNull() & (F.col("value") != "")
    large = there & (F.col("n") >= rows)
    return values.groupBy("column").agg(
        (F.sum(F.when(there, F.col("n")).otherwise(0)) / F.sum("n")).alias("present"), F.count_if(there).alias("n_distinct"),
        (F.sum(F.when(there, F.col("n")).otherwise(0)) / F.greatest(F.count_if(there), F.lit(1))).alias("rows_per_value"),
        F.percentile(F.when(large, F.col("categories")), F.lit(0.5)).alias("median_categories"), (F.sum(F.when(large, F.col("n")).otherwise(0)) / F.sum("n")).alias("rows_covered"))


def concentration(df: DataFrame, vendor: str, label: str) -> DataFrame:
    """vendor, n_rows, n_categories."""
    pairs = df.where(F.col(vendor).isNotNull()).groupBy(vendor, label).agg(F.count("*").alias("n"))
    return pairs.groupBy(vendor).agg(F.sum("n").alias("n_rows"), F.count(label).alias("n_categories"))


def quantiles(vendors: DataFrame, shares: Sequence[float] = (0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """One row: the quantiles of n_rows, and the least number of rows that leaves 20 vendors (50, the 90 % quantile, 10, 5, 1 are tried)."""
    q = vendors.agg(*[F.percentile("n_rows", F.lit(s)).alias(f"q{int(s * 100)}") for s in shares], F.percentile("n_rows", F.lit(0.9)).alias("_p90"))
    left = vendors.join(F.broadcast(q.select("_p90")), F.lit(True)).agg(*[F.count_if(F.col("n_rows") >= (F.col("_p90") if t == "p90" else F.lit(t))).alias(f"_n{t}") for t in (50, "p90", 10, 5, 1)])
    choice = reduce(lambda rest, t: F.when(F.col(f"_n{t}") >= 20, F.col("_p90") if t == "p90" else F.lit(float(t))).otherwise(rest), (5, 10, "p90", 50), F.lit(1.0))
    return q.join(F.broadcast(left), F.lit(True)).select(*[f"q{int(s * 100)}" for s in shares], choice.alias("min_rows"))


def held_out_coverage(train: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """One row: the share of held-out rows whose value the training rows have."""
    seen = train.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_seen", F.lit(1))
    return held.join(seen, column, "left").agg(F.avg(F.coalesce("_seen", F.lit(0))).alias("seen_share"))


def value_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
