"""Accuracy by level, prefix, path and confidence band. A null truth or prediction is wrong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxolith.functions import arrays as A


def right(truth: str, predicted: str) -> Column:
    return F.coalesce(F.col(truth).cast("string") == F.col(predicted).cast("string"), F.lit(False))


def _stack(row: DataFrame, items: Sequence[tuple[str, Sequence[Column]]], names: Sequence[str]) -> DataFrame:
    each = [F.struct(F.lit(label).alias(names[0]), *[c.alias(n) for c, n in zip(values, names[1:], strict=True)]) for label, values in items]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def per_level(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """level, accuracy, n_classes (of the truth): one aggregation for all levels."""
    row = df.agg(*[F.avg(right(c, f"predicted_{c}").cast("int")).alias(f"a{k}") for k, c in enumerate(levels)], *[F.count_distinct(c).alias(f"n{k}") for k, c in enumerate(levels)])
    return _stack(row, [(c, (F.col(f"a{k}"), F.col(f"n{k}"))) for k, c in enumerate(levels)], ("level", "accuracy", "n_classes"))


def per_prefix(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """depth, accuracy of all levels down to it."""
    row = df.agg(*[F.avg(reduce(lambda a, b: a & b, (right(c, f"predicted_{c}") for c in levels[: k + 1])).cast("int")).alias(f"a{k}") for k in range(len(levels))])
    each = [F.struct(F.lit(k + 1).alias("depth"), F.col(f"a{k}").alias("accuracy")) for k in range(len(levels))]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def path_accuracy(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    return df.agg(F.avg(reduce(lambda a, b: a & b, (right(c, f"predicted_{c}") for c in levels)).cast("int")).alias("accuracy"))


def top_k(df: DataFrame, probs: str, code: str, k: int = 5) -> DataFrame:
    """One row: the share of rows whose code is among the k most probable; code -1 never is."""
    return df.agg(F.avg(F.coalesce((A.rank_of(F.col(probs), F.col(code)) < k).cast("int"), F.lit(0))).alias("accuracy"))


def confusions(df: DataFrame, truth: str, predicted: str, n: int = 20) -> DataFrame:
    """actual, predicted, count, share of errors of the commonest confusions."""
    wrong = df.where(~right(truth, predicted)).groupBy(F.col(truth).alias("actual"), F.col(predicted).alias("predicted")).count()
    total = wrong.agg(F.sum("count").alias("_total"))
    return wrong.join(F.broadcast(total), F.lit(True)).select("actual", "predicted", "count", (F.col("count") / F.col("_total")).alias("error_share")).orderBy(F.desc("count"), "actual", "predicted").limit(n)


def edges(n: int) -> list[float]:
    """Band edges as multiples of the width: not what dividing a value by the width rounds to."""
    return [k * (1.0 / n) for k in range(n)] + [1.0]


def band(c: Column, n: int) -> Column:
    """The number of the band of [0, 1] that the value is in; 1 is in the last."""
    return F.least(F.greatest(F.size(F.filter(F.lit(edges(n)), lambda e: c >= e)) - 1, F.lit(0)), F.lit(n - 1))


def by_band(df: DataFrame, confidence: str, correct: Column, n: int = 10) -> DataFrame:
    """band, low, high, rows, mean_confidence, accuracy, gap; empty bands are there, with the middle as mean."""
    found = df.select(band(F.col(confidence).cast("double"), n).alias("band"), F.col(confidence).cast("double").alias("c"), correct.cast("int").alias("r")).groupBy("band").agg(F.count("*").alias("rows"), F.avg("c").alias("m"), F.avg("r").alias("accuracy"))
    e = edges(n)
    every = df.sparkSession.createDataFrame([(k, e[k], e[k + 1]) for k in range(n)], "band int, low double, high double")
    out = every.join(found, "band", "left").select("band", "low", "high", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("m", (F.col("low") + F.col("high")) / 2).alias("mean_confidence"), "accuracy")
    return out.withColumn("gap", F.abs(F.col("accuracy") - F.col("mean_confidence")))


def evaluate(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """measure, level, value: all accuracies of a scored frame in one table."""
    parts = [
        per_level(df, levels).select(F.lit("level").alias("measure"), "level", F.col("accuracy").alias("value")),
        per_prefix(df, levels).select(F.lit("prefix").alias("measure"), F.col("depth").cast("string").alias("level"), F.col("accuracy").alias("value")),
        path_accuracy(df, levels).select(F.lit("path").alias("measure"), F.lit("all").alias("level"), F.col("accuracy").alias("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def compared(runs: Mapping[str, DataFrame], levels: Sequence[str]) -> DataFrame:
    """run, and a column of accuracy for each level and the path."""
    parts = [per_level(df, levels).select(F.lit(name).alias("run"), "level", "accuracy").unionByName(path_accuracy(df, levels).select(F.lit(name).alias("run"), F.lit("path").alias("level"), "accuracy")) for name, df in runs.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("run").pivot("level", [*levels, "path"]).agg(F.first("accuracy"))


def weighted_loss(df: DataFrame, probs: Sequence[str], codes: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """One row: the weighted sum of the levels' mean negative log likelihoods; rows of unknown class don't count."""
    each = [F.avg(F.when(F.col(c) >= 0, -F.log(F.greatest(F.get(F.col(p), F.col(c)).cast("double"), F.lit(A.FLOOR))))) * w for p, c, w in zip(probs, codes, weights, strict=True)]
    return df.agg(reduce(lambda a, b: a + b, each).alias("loss"))


def score_summary(scored: DataFrame, depth: str = "assigned_depth", confidence: str = "assigned_confidence") -> DataFrame:
    """depth, rows, share, mean confidence."""
    out = scored.groupBy(depth).agg(F.count("*").alias("rows"), F.avg(confidence).alias("mean_confidence"))
    total = out.agg(F.sum("rows").alias("_t"))  # over the few grouped rows: the scored ones are not read again
    return out.join(F.broadcast(total), F.lit(True)).select(depth, "rows", (F.col("rows") / F.col("_t")).alias("share"), "mean_confidence")


def confidence_volume(scored: DataFrame, confidence: str, grid: Sequence[float]) -> DataFrame:
    """threshold, share of rows at or above it: one aggregation."""
    row = scored.agg(*[F.avg((F.col(confidence) >= t).cast("int")).alias(f"t{k}") for k, t in enumerate(grid)])
    each = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("share")) for k, t in enumerate(grid)]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def confidence_bands(scored: DataFrame, confidence: str, bounds: Sequence[float]) -> DataFrame:
    """low, high, rows, share, share_from_top of bands (low, high] closed on the right; the first one holds its low end
    too. The cumulative share counts from the highest band down, over a table of one row a band."""
    c = F.col(confidence).cast("double")
    pairs = list(zip(bounds, bounds[1:], strict=False))
    place = reduce(lambda rest, kv: F.when((c <= kv[1][1]) & ((c > kv[1][0]) if kv[0] else (c >= kv[1][0])), kv[0]).otherwise(rest), enumerate(pairs), F.lit(None).cast("int"))
    found = scored.select(place.alias("band")).where("band is not null").groupBy("band").agg(F.count("*").alias("rows"))
    every = scored.sparkSession.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pairs)], "band int, low double, high double")
    out = every.join(found, "band", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    total = F.greatest(F.sum("rows").over(W.partitionBy(F.lit(0))), F.lit(1))
    down = W.partitionBy(F.lit(0)).orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, 0)
    return out.select("low", "high", "rows", (F.col("rows") / total).alias("share"), (F.sum("rows").over(down) / total).alias("share_from_top"))


def by_fold(oof: DataFrame, correct: Column, fold: str = "fold") -> DataFrame:
    """fold, rows, accuracy, with a fold "all"."""
    rows = oof.select(F.col(fold).cast("string").alias("fold"), correct.cast("int").alias("_r"))
    return rows.rollup("fold").agg(F.count("*").alias("rows"), F.avg("_r").alias("accuracy")).select(F.coalesce("fold", F.lit("all")).alias("fold"), "rows", "accuracy")
