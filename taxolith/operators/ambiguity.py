"""What no model that reads only the text could get right."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxolith.functions import text as T

PATH = "path"
SEPARATOR = "|"


def _pairs(df: DataFrame, text_col: str, label: Column, normalise: bool = True) -> DataFrame:
    """key, label, n. Null labels are labels."""
    key = T.text_key(F.col(text_col)) if normalise else F.coalesce(F.col(text_col), F.lit(""))
    return df.groupBy(key.alias("key"), F.coalesce(label.cast("string"), F.lit("None")).alias("label")).agg(F.count("*").alias("n"))


def _groups(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("modal"), F.count("*").alias("n_labels"))


def _bounds(groups: DataFrame, *by: str, least: int = 2) -> DataFrame:
    shared, several = F.col("n") >= least, F.col("n_labels") > 1
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    rows = F.coalesce(F.sum("n"), F.lit(0))
    out = groups.groupBy(*by).agg(
        rows.alias("n_rows"), F.count("*").alias("n_groups"), total(shared).alias("n_shared_rows"), total(several).alias("n_ambiguous_rows"),
        F.count_if(several).alias("n_ambiguous_groups"), F.coalesce(F.sum(F.col("n") - F.col("modal")), F.lit(0)).alias("n_unwinnable"))
    n = F.greatest("n_rows", F.lit(1))
    return out.withColumns({"bound": 1 - F.col("n_unwinnable") / n, "coverage": F.col("n_shared_rows") / n, "ambiguous_share": F.col("n_ambiguous_rows") / n})


def report(df: DataFrame, text_col: str, level: str, normalise: bool = True, least: int = 2) -> DataFrame:
    """One row: rows, groups of equal texts, ambiguous and unwinnable rows, and the best accuracy there can be."""
    return _bounds(_groups(_pairs(df, text_col, F.col(level), normalise)), least=least).select(F.lit(level).alias("level"), "*")


def path_column(levels: Sequence[str]) -> Column:
    return F.concat_ws(SEPARATOR, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in levels])


def by_level(df: DataFrame, text_col: str, levels: Sequence[str], normalise: bool = True) -> DataFrame:
    """report() of each level and of the whole path, in one pass."""
    key = T.text_key(F.col(text_col)) if normalise else F.coalesce(F.col(text_col), F.lit(""))
    each = [F.struct(F.lit(c).alias("level"), F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("label")) for c in levels]
    each.append(F.struct(F.lit(PATH).alias("level"), path_column(levels).alias("label")))
    pairs = df.select(key.alias("key"), F.explode(F.array(*each)).alias("x")).groupBy("x.level", "key", "x.label").agg(F.count("*").alias("n"))
    groups = pairs.groupBy("level", "key").agg(F.sum("n").alias("n"), F.max("n").alias("modal"), F.count("*").alias("n_labels"))
    return _bounds(groups, "level")


def cleaning_cost(df: DataFrame, raw_col: str, clean_col: str, level: str) -> DataFrame:
    """report() on the raw and on the cleaned text."""
    return report(df, raw_col, level).withColumn("text", F.lit("raw")).unionByName(report(df, clean_col, level).withColumn("text", F.lit("cleaned")))


def examples(df: DataFrame, text_col: str, level: str, n: int = 20, names: DataFrame | None = None) -> DataFrame:
    """key, n, n_labels, labels ("label xN, ...", most rows first) of the largest ambiguous groups; names(label, name) are shown too."""
    pairs = _pairs(df, text_col, F.col(level))
    groups = _groups(pairs).where("n_labels > 1").orderBy(F.desc("n"), F.desc("n_labels"), "key").limit(n).select("key", F.col("n").alias("rows"), "n_labels")
    own = pairs.join(F.broadcast(groups), "key")  # at most n groups
    if names is not None:
        own = own.join(names.select(F.col("label"), F.col("name")), "label", "left").withColumn("label", F.concat("label", F.lit(" ("), F.coalesce("name", F.lit("?")), F.lit(")")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "label"))), lambda x: F.concat(x["label"], F.lit(" x"), (-x["m"]).cast("string"))), ", ")
    return own.groupBy("key", "rows", "n_labels").agg(listed.alias("labels"))


def with_bucket(df: DataFrame, text_col: str, level: str, reference: DataFrame | None = None) -> DataFrame:
    """df with `bucket`: by the labels that the reference rows (else df itself) have for the text."""
    keyed = df.withColumn("_key", T.text_key(F.col(text_col)))
    groups = _groups(_pairs(reference if reference is not None else df, text_col, F.col(level))).select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.col("n_labels").alias("_labels"))
    if reference is not None:
        bucket = F.when(F.col("_labels").isNull(), "unseen in training").when(F.col("_labels") == 1, "seen, one label").otherwise("seen, several labels")
    else:
        bucket = F.when(F.col("_n") == 1, "singleton").when(F.col("_labels") > 1, "ambiguous").otherwise("consistent duplicate")
    return keyed.join(groups, "_key", "left").withColumn("bucket", bucket).drop("_key", "_n", "_labels")


def error_overlap(scored: DataFrame, text_col: str, truth: str, predicted: str, reference: DataFrame | None = None, level: str | None = None) -> DataFrame:
    """bucket, rows, share, accuracy, ceiling, errors, error_share. A null truth or prediction is wrong.

    The ceiling is 1 for texts of one label, the majority bound for ambiguous ones, and unknown for unseen ones."""
    level = level or truth
    rows = with_bucket(scored.withColumn(level, F.col(truth)), text_col, level, reference)
    right = F.coalesce(F.col(predicted).cast("string") == F.col(truth).cast("string"), F.lit(False)).cast("int")
    base = rows.withColumn("_right", right).groupBy("bucket").agg(F.count("*").alias("rows"), F.avg("_right").alias("accuracy"), F.sum(1 - F.col("_right")).alias("errors"))
    pairs = rows.groupBy("bucket", T.text_key(F.col(text_col)).alias("key"), F.coalesce(F.col(truth).cast("string"), F.lit("None")).alias("label")).agg(F.count("*").alias("n"))
    bound = pairs.groupBy("bucket", "key").agg(F.sum("n").alias("n"), F.max("n").alias("modal")).groupBy("bucket").agg((F.sum("modal") / F.sum("n")).alias("bound"))
    total = base.agg(F.sum("rows").alias("_rows"), F.sum("errors").alias("_errors"))
    ceiling = F.when(F.col("bucket").isin("seen, one label", "consistent duplicate"), 1.0).when(F.col("bucket").isin("seen, several labels", "ambiguous"), F.col("bound"))
    joined = base.join(bound, "bucket").join(F.broadcast(total), F.lit(True))
    return joined.select("bucket", "rows", (F.col("rows") / F.col("_rows")).alias("share"), "accuracy", ceiling.alias("ceiling"), "errors", (F.col("errors") / F.greatest("_errors", F.lit(1))).alias("error_share"))


def realised(bounds: DataFrame, achieved: Mapping[str, float]) -> DataFrame:
    """level, bound, achieved, headroom, realised: bounds against accuracies reached."""
    reached = reduce(lambda rest, kv: F.when(F.col("level") == kv[0], F.lit(float(kv[1]))).otherwise(rest), achieved.items(), F.lit(None).cast("double"))
    return bounds.select("level", "bound", reached.alias("achieved")).withColumns({"headroom": F.col("bound") - F.col("achieved"), "realised": F.col("achieved") / F.col("bound")})


def with_row_number(df: DataFrame, by: Sequence[str], order: Sequence) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
