"""Calibration of confidences, thresholds for a target accuracy, and assignment at the deepest level that earns it."""

from __future__ import annotations

import math
from bisect import bisect
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.operators import evaluation as E

GRID = [round(0.05 + 0.01 * k, 3) for k in range(95)]
TARGET = 0.95
#: Temperatures of a grid that are tried on each side of the best known one.
AROUND = 2


def fit_temperature(df: DataFrame, logits: str, code: str, steps: int = 25) -> float:
    """The temperature with the least mean cross-entropy, by Newton steps on its logarithm; each is one aggregation."""
    rows = df.where(F.col(code) >= 0).select(F.transform(logits, lambda x: x.cast("double")).alias("z"), F.col(code).alias("y"))
    log_t = 0.0
    for _ in range(steps):
        t = math.exp(log_t)
        moments = rows.select("z", "y", A.softmax(F.col("z"), t).alias("p")).select(F.get("z", F.col("y")).alias("own"), A.total(F.zip_with("p", "z", lambda a, b: a * b)).alias("mean"), A.total(F.zip_with("p", "z", lambda a, b: a * b * b)).alias("square"))
        slope = (F.col("own") - F.col("mean")) / t
        bend = -slope + (F.col("square") - F.col("mean") * F.col("mean")) / (t * t)
        row = moments.agg(F.avg(slope).alias("g"), F.avg(bend).alias("h")).first()
        if row.g is None:
            return 1.0
        move = row.g / row.h if row.h > 1e-9 else math.copysign(0.5, row.g)
        log_t -= max(-1.0, min(1.0, move))
        log_t = max(-5.0, min(5.0, log_t))
        if abs(move) < 1e-7:
            break
    return math.exp(log_t)


def fit_temperature_on(df: DataFrame, logits: str, code: str, grid: Sequence[float]) -> tuple[float, float] | None:
    """The temperature of an ascending grid with the least mean cross-entropy, and that mean. The mean is convex in 1 / temperature,
    so the grid's best lies next to the free fit, or is the grid's end on its side; what is tried moves on if its edge is its best."""
    rows = df.where(F.col(code) >= 0).select(F.transform(logits, lambda x: x.cast("double")).alias("z"), F.col(code).alias("y"))
    best = min(bisect(grid, fit_temperature(df, logits, code)), len(grid) - 1)
    loss: dict[int, float] = {}

    def entropy(t: float) -> Column:
        return A.log_sum_exp(F.transform("z", lambda x: x / t)) - F.get("z", F.col("y")) / t

    while not {max(best - 1, 0), best, min(best + 1, len(grid) - 1)} <= loss.keys():
        near = range(max(best - AROUND, 0), min(best + AROUND + 1, len(grid)))
        found = rows.agg(*[F.avg(entropy(grid[k])) for k in near]).first()
        if found[0] is None:
            return None
        loss |= dict(zip(near, found, strict=True))
        best = min(loss, key=lambda k: (loss[k], k))
    return grid[best], loss[best]


def with_temperature(df: DataFrame, logits: str, temperature: float, out: str) -> DataFrame:
    return df.withColumn(out, A.softmax(F.col(logits), temperature))


def fit_isotonic(df: DataFrame, confidence: str, correct: Column) -> IsotonicRegressionModel:
    rows = df.select(F.col(confidence).cast("double").alias("features"), correct.cast("double").alias("label"))
    return IsotonicRegression(featuresCol="features", labelCol="label").fit(rows)


def with_isotonic(df: DataFrame, probs: str, model: IsotonicRegressionModel) -> DataFrame:
    """The largest share replaced by its calibrated value, the others scaled to keep the sum 1. The argmax may change."""
    bounds, values = [float(x) for x in model.boundaries], [float(x) for x in model.predictions]
    top = F.array_max(probs).cast("double")
    # piecewise linear between the model's steps, constant outside: the model's steps are arrays, looked up by place
    slopes = [(values[k + 1] - values[k]) / (bounds[k + 1] - bounds[k]) if bounds[k + 1] > bounds[k] else 0.0 for k in range(len(bounds) - 1)] + [0.0]
    place = F.greatest(F.size(F.filter(F.lit(bounds), lambda b: b <= top)) - 1, F.lit(0))
    steps = A.bind(place, lambda k: F.get(F.lit(values), k) + F.greatest(top - F.get(F.lit(bounds), k), F.lit(0.0)) * F.get(F.lit(slopes), k))
    new = F.greatest(F.lit(A.FLOOR), F.least(F.lit(1 - A.FLOOR), steps))
    known = F.struct(F.col(probs).alias("p"), new.alias("new"), top.alias("top"), A.arg_max(F.col(probs)).alias("at"))
    return df.withColumn(probs, A.bind(known, lambda v: F.transform(v["p"], lambda x, i: F.when(i == v["at"], v["new"]).otherwise(x.cast("double") * (1 - v["new"]) / F.greatest(1 - v["top"], F.lit(A.FLOOR))))))


def normalised(df: DataFrame, probs: str) -> DataFrame:
    """Rows that don't sum to 1 are taken as logits."""
    return df.withColumn(probs, F.when(F.abs(A.total(F.col(probs)) - 1) <= 1e-3, F.transform(probs, lambda x: x.cast("double"))).otherwise(A.softmax(F.col(probs))))


def reliability(df: DataFrame, confidence: str, correct: Column, n: int = 10) -> DataFrame:
    return E.by_band(df, confidence, correct, n)


def calibration_error(df: DataFrame, confidence: str, correct: Column, n: int = 10) -> DataFrame:
    """One row: the mean gap between confidence and accuracy, by the bands' rows."""
    return reliability(df, confidence, correct, n).agg(F.coalesce(F.sum(F.col("rows") * F.coalesce("gap", F.lit(0.0))) / F.greatest(F.sum("rows"), F.lit(1)), F.lit(0.0)).alias("ece"))


def _cells(df: DataFrame, by: Sequence[str], confidence: str, correct: str, grid: Sequence[float]) -> DataFrame:
    """Rows and right ones by how many of the grid's thresholds they reach: at most one row a cell."""
    place = F.size(F.filter(F.lit([float(g) for g in grid]), lambda g: F.col(confidence).cast("double") >= g))
    return df.select(*by, place.alias("cell"), F.col(correct).cast("long").alias("r")).groupBy(*by, "cell").agg(F.count("*").alias("n"), F.sum("r").alias("r"))


def coverage_table(df: DataFrame, confidence: str, correct: str, grid: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """threshold, n_auto, coverage, accuracy, n_reviewed, errors_auto for the whole grid from one pass over df."""
    cells = _cells(df, by, confidence, correct, grid)
    reached = F.array(*[F.struct(F.sum(F.when(F.col("cell") > k, F.col("n")).otherwise(0)).alias("n_auto"), F.sum(F.when(F.col("cell") > k, F.col("r")).otherwise(0)).alias("right"), F.lit(float(g)).alias("threshold")) for k, g in enumerate(grid)])
    rows = cells.groupBy(*by).agg(F.sum("n").alias("total"), reached.alias("x")).select(*by, "total", F.explode("x").alias("x"))
    n = F.col("x.n_auto")
    return rows.select(*by, "x.threshold", n.alias("n_auto"), (n / F.greatest("total", F.lit(1))).alias("coverage"), F.when(n > 0, F.col("x.right") / n).alias("accuracy"), (F.col("total") - n).alias("n_reviewed"), (n - F.col("x.right")).alias("errors_auto"))


def thresholds(df: DataFrame, confidence: str, correct: str, target: float = TARGET, coverage: float = 0.0, grid: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """threshold: the lowest of the grid whose rows reach the target and the coverage; null if none does."""
    good = (F.col("accuracy") >= target) & (F.col("coverage") >= coverage)
    table = coverage_table(df, confidence, correct, grid, by)
    return table.groupBy(*by).agg(F.min(F.when(good, F.col("threshold"))).alias("threshold"))


def _long(df: DataFrame, levels: Sequence[str], confidence: str, whole_prefix: bool) -> DataFrame:
    """depth, confidence, correct for each level of each row."""
    each = []
    for k, c in enumerate(levels):
        correct = [E.right(x, f"predicted_{x}") for x in (levels[: k + 1] if whole_prefix else [c])]
        each.append(F.struct(F.lit(k + 1).alias("depth"), F.col(confidence.format(depth=k + 1, level=c)).cast("double").alias("confidence"), reduce(lambda a, b: a & b, correct).alias("correct")))
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def prefix_thresholds(df: DataFrame, levels: Sequence[str], target: float = TARGET) -> DataFrame:
    """depth, threshold on the mass of the heaviest prefix. Right means the best path's prefix: it may be another one."""
    return thresholds(_long(df, levels, "mass_{depth}", True), "confidence", "correct", target, by=["depth"])


def level_thresholds(df: DataFrame, levels: Sequence[str], target: float = TARGET) -> DataFrame:
    """depth, threshold on each level's own probability of the predicted class."""
    return thresholds(_long(df, levels, "level_confidence_{level}", False), "confidence", "correct", target, by=["depth"])


def confidence_report(df: DataFrame, levels: Sequence[str], target: float = TARGET, n: int = 10) -> DataFrame:
    """depth, rows, accuracy, ece, threshold of every level, from one long frame."""
    long = _long(df, levels, "level_confidence_{level}", False)
    bands = long.withColumn("band", E.band(F.col("confidence"), n)).groupBy("depth", "band").agg(F.count("*").alias("rows"), F.avg("confidence").alias("m"), F.avg(F.col("correct").cast("int")).alias("a"))
    out = bands.groupBy("depth").agg(F.sum("rows").alias("rows"), (F.sum(F.col("rows") * F.col("a")) / F.sum("rows")).alias("accuracy"), (F.sum(F.col("rows") * F.abs(F.col("a") - F.col("m"))) / F.sum("rows")).alias("ece"))
    return out.join(thresholds(long, "confidence", "correct", target, by=["depth"]), "depth")


def path_report(df: DataFrame, levels: Sequence[str], confidence: str = "confidence", target: float = TARGET, n: int = 10) -> DataFrame:
    """One row: rows, accuracy, ece, threshold of the path's confidence, where right means right at every level."""
    right = reduce(lambda a, b: a & b, (E.right(c, f"predicted_{c}") for c in levels))
    own = df.select(F.col(confidence).cast("double").alias("confidence"), right.alias("correct"))
    bands = own.withColumn("band", E.band(F.col("confidence"), n)).groupBy("band").agg(F.count("*").alias("rows"), F.avg("confidence").alias("m"), F.avg(F.col("correct").cast("int")).alias("a"))
    out = bands.agg(F.sum("rows").alias("rows"), (F.sum(F.col("rows") * F.col("a")) / F.sum("rows")).alias("accuracy"), (F.sum(F.col("rows") * F.abs(F.col("a") - F.col("m"))) / F.sum("rows")).alias("ece"))
    return out.join(F.broadcast(thresholds(own, "confidence", "correct", target)), F.lit(True))  # one row each


def as_map(table: DataFrame) -> dict[int, float | None]:
    return {r.depth: r.threshold for r in table.collect()}  # one row a depth


def cascade(df: DataFrame, levels: Sequence[str], limits: Mapping[int, float | None], confidence: str) -> DataFrame:
    """assigned_depth (the deepest whose confidence reaches its limit, else 0), assigned_confidence, needs_review;
    predictions below that depth become null. confidence: a column name with {depth} or {level} in it."""
    own = {d: F.col(confidence.format(depth=d, level=c)) for d, c in enumerate(levels, 1)}
    depth, sure = F.lit(0), F.lit(None).cast("double")
    for d in range(1, len(levels) + 1):
        if limits.get(d) is not None:
            good = F.coalesce(own[d] >= limits[d], F.lit(False))
            depth, sure = F.when(good, d).otherwise(depth), F.when(good, own[d].cast("double")).otherwise(sure)
    out = df.withColumns({"assigned_depth": depth, "assigned_confidence": sure})
    out = out.withColumns({f"predicted_{c}": F.when(F.col("assigned_depth") >= d, F.col(f"predicted_{c}")) for d, c in enumerate(levels, 1)})
    return out.withColumn("needs_review", F.col("assigned_depth") < len(levels))


def cascade_by_prefix(df: DataFrame, levels: Sequence[str], limits: Mapping[int, float | None]) -> DataFrame:
    return cascade(df, levels, limits, "mass_{depth}")


def cascade_by_level(df: DataFrame, levels: Sequence[str], limits: Mapping[int, float | None]) -> DataFrame:
    return cascade(df, levels, limits, "level_confidence_{level}")


def cascade_report(assigned: DataFrame, levels: Sequence[str]) -> DataFrame:
    """depth, rows, share, accuracy at each assigned depth; all depths are there, depth 0 has no accuracy."""
    right = F.lit(None).cast("int")
    for d, c in enumerate(levels, 1):
        right = F.when(F.col("assigned_depth") == d, E.right(c, f"predicted_{c}").cast("int")).otherwise(right)
    found = assigned.select("assigned_depth", right.alias("r")).groupBy("assigned_depth").agg(F.count("*").alias("rows"), F.avg("r").alias("accuracy"))
    every = assigned.sparkSession.createDataFrame([(d,) for d in range(len(levels) + 1)], "assigned_depth int")
    total = found.agg(F.greatest(F.coalesce(F.sum("rows"), F.lit(0)), F.lit(1)).alias("_t"))
    out = every.join(found, "assigned_depth", "left").join(F.broadcast(total), F.lit(True))
    return out.select("assigned_depth", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) / F.col("_t")).alias("share"), "accuracy")
