"""A table from text to its modal path, and what it adds to a model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolith.functions import text as T


def fit(df: DataFrame, text_col: str, levels: Sequence[str]) -> DataFrame:
    """text_key, levels..., support, purity: the path that most rows of a text have; ties go to the least path."""
    counts = df.groupBy(T.text_key(F.col(text_col)).alias("text_key"), *levels).agg(F.count("*").alias("n"))
    best = counts.groupBy("text_key").agg(F.min(F.struct((-F.col("n")).alias("m"), *levels)).alias("x"), F.sum("n").alias("support"))
    return best.select("text_key", *[F.col(f"x.{c}").alias(c) for c in levels], "support", (-F.col("x.m") / F.col("support")).alias("purity"))


def predict(df: DataFrame, text_col: str, table: DataFrame, levels: Sequence[str], support: int = 2, purity: float = 0.0) -> DataFrame:
    """df with hit, lookup_<level>, support and purity; the two figures are there even if the gates say no."""
    own = table.select(F.col("text_key").alias("_key"), *[F.col(c).alias(f"lookup_{c}") for c in levels], "support", "purity")
    out = df.withColumn("_key", T.text_key(F.col(text_col))).join(own, "_key", "left").drop("_key")
    hit = F.coalesce((F.col("support") >= support) & (F.col("purity") >= purity), F.lit(False))
    out = out.withColumn("hit", hit).withColumns({"support": F.coalesce("support", F.lit(0)), "purity": F.coalesce("purity", F.lit(0.0))})
    return out.withColumns({f"lookup_{c}": F.when(F.col("hit"), F.col(f"lookup_{c}")) for c in levels})


def coverage(looked: DataFrame) -> DataFrame:
    return looked.agg(F.avg(F.col("hit").cast("int")).alias("coverage"))


def true_ceiling(looked: DataFrame, truth: Sequence[str]) -> DataFrame:
    """One row: accuracy of the table on the rows that it knows at all."""
    right = F.lit(True)
    for c in truth:
        right = right & F.coalesce(F.col(f"lookup_{c}") == F.col(c), F.lit(False))
    return looked.where("support >= 1").agg(F.avg(right.cast("int")).alias("ceiling"), F.count("*").alias("rows"))


def blend(looked: DataFrame, levels: Sequence[str], confidence: str = "confidence") -> DataFrame:
    """Predictions of the table where it fires, else the model's (predicted_<level>); `source` says which."""
    out = looked.withColumns({f"predicted_{c}": F.when(F.col("hit"), F.col(f"lookup_{c}")).otherwise(F.col(f"predicted_{c}")) for c in levels})
    return out.withColumns({confidence: F.when(F.col("hit"), F.col("purity")).otherwise(F.col(confidence)), "source": F.when(F.col("hit"), "lookup").otherwise("model")})


def compare_by_bucket(rows: DataFrame, sources: Mapping[str, str], truth: str) -> DataFrame:
    """source, bucket, rows, accuracy, with a bucket "all": predictions of several columns side by side."""
    each = F.array(*[F.struct(F.lit(name).alias("source"), F.coalesce(F.col(c).cast("string") == F.col(truth).cast("string"), F.lit(False)).cast("int").alias("right")) for name, c in sources.items()])
    long = rows.select("bucket", F.explode(each).alias("x")).select("bucket", "x.*")
    return long.rollup("source", "bucket").agg(F.count("*").alias("rows"), F.avg("right").alias("accuracy")).where("source is not null").select("source", F.coalesce("bucket", F.lit("all")).alias("bucket"), "rows", "accuracy")
