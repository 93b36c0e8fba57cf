"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (3 to 6 bytes of its UTF-8 form, A-Z lower-cased) that occur in it. The fit
takes a bounded sample of labelled rows (`FIT_ROWS` of each class at most, in the order of a hash of the key), counts
the n-grams by class, keeps those whose log-count ratio stands clear of noise (`MIN_Z`), and fits a logistic
regression on indicator * ratio. Scoring runs over every byte of every text inside map tasks; only the model (a fixed
size table) is sent to them.

Defined cases: null and empty texts get the intercept's score; repeated rows score alike, row by row; keys with several
labels count as toxic if any label is 1, and one with several texts gives the one that a hash puts first; null labels and null keys are not learned from; with one class or none to
learn from, every score is the share of toxic rows (0 if there are none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

BITS = 20
ORDERS = (3, 4, 5, 6)
#: Rows of each class that the fit reads at most.
FIT_ROWS = 1500
MIN_DF = 4
MIN_Z = 3.5
MOST_FEATURES = 8000
FOLDS = 5
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the hash of the n-gram that begins at each byte."""
    low = LOWER[data].astype(np.uint32)
    code = low
    for n in range(2, max(ORDERS) + 1):
        if len(low) < n:
            return
        code = code[:-1] * np.uint32(0x01000193) + low[n - 1 :]
        if n in ORDERS:
            spread = code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            yield n, ((spread ^ (spread >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)


def row_features(data: np.ndarray, at: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs. keep: feature -> number + 1 of a kept one; others are left out."""
    found = []
    rows = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(at))
    for n, code in grams(data):
        whole = rows[: len(code)] == rows[n - 1 :]
        if keep is None:
            place = np.flatnonzero(whole)
            value = code[place].astype(np.int64)
        else:
            number = keep[code]
            place = np.flatnonzero((number > 0) & whole)
            value = number[place].astype(np.int64) - 1
        found.append(np.unique((rows[place] << BITS) | value))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass
class Model:
    keep: np.ndarray  # feature -> number + 1, 0 if not used
    weight: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        row, feature = row_features(data, at, self.keep)
        total = np.bincount(row, self.weight[feature], len(at) - 1) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, toxic) of at most `rows` labelled keys a class whose crc32(key) mod FOLDS is not 0: one row a key, whatever number
    the documents have of it."""
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(rows).unionByName(marked.where("toxic <> 1").orderBy(*order).limit(rows))
    found = common.documents(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * rows short rows
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts -> for each feature in them, how many have it by class."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in common.chunks(batches, "text"):
        label = batch.column("toxic").to_numpy() == 1
        row, feature = row_features(*common.raw(batch.column("text")))
        for k in (0, 1):
            counts[k] += np.bincount(feature[label[row] == k], minlength=1 << BITS).astype(np.int32)
    there = np.flatnonzero(counts.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *(pa.array(c[there]) for c in counts)], ["feature", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Feature counts stay in Spark; the driver gets the chosen features, and which of them each sampled row has."""
    chosen = common.written(sample(docs, labels, rows).select("text", F.col("toxic").cast("int").alias("toxic")), "sample")
    size = chosen.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("positive")).first()
    if size.positive in (0, size.n):
        return Model(np.zeros(1 << BITS, np.uint16), np.zeros(1), 40.0 if size.positive else -40.0)
    positive, negative = size.positive, size.n - size.positive
    counts = common.mapped(chosen.repartition(8), _counted, "feature int, n0 int, n1 int").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n0") + F.col("n1") >= MIN_DF)
    p, q = (F.col("n1") + 1) / (positive + 2), (F.col("n0") + 1) / (negative + 2)
    error = F.sqrt((1 - p) / (p * (positive + 2)) + (1 - q) / (q * (negative + 2)))
    best = counts.select("feature", F.log(p / q).alias("ratio"), (F.abs(F.log(p / q)) / error).alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES).collect()
    keep = np.zeros(1 << BITS, np.uint16)
    keep[[r.feature for r in best]] = np.arange(1, len(best) + 1)
    if not best:
        return Model(keep, np.zeros(1), float(np.log(positive / negative)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            row, number = row_features(*common.raw(batch.column("text")), keep)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            sets = [number[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(sets, pa.binary())], ["toxic", "features"])

    got = sorted((r.toxic, bytes(r.features)) for r in common.mapped(chosen, kept, "toxic int, features binary").collect())
    return learned([np.frombuffer(f, np.uint16) for _, f in got], np.array([t == 1 for t, _ in got], float), keep, np.array([r.ratio for r in best]))


def learned(sets: list[np.ndarray], y: np.ndarray, keep: np.ndarray, scale: np.ndarray) -> Model:
    """A logistic regression on the features that each row has, times their log-count ratios; classes weigh the same."""
    positive, n = y.sum(), len(scale)
    feature = np.concatenate(sets).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    value = scale[feature]
    cost = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive)))
    w, bias, m, v, mb, vb = np.zeros(n), 0.0, 0.0, 0.0, 0.0, 0.0
    for step in range(1, 401):  # Adam on the whole sample
        margin = np.bincount(row, value * w[feature], len(y)) + bias
        gap = cost * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y) / len(y)
        grad, gb = np.bincount(feature, value * gap[row], n) + 1e-4 * w, gap.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        rate = 0.02 / (1 - 0.9**step)
        w -= rate * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**step)) + 1e-9)
    return Model(keep, w * scale, float(bias))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(*common.raw(batch.column("text"))))], ["doc_id", "score"])

    return common.mapped(common.documents(docs), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    columns = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "text"):
            yield batch.filter(pa.array(model.score(*common.raw(batch.column("text"))) < 0.5))

    common.tune(docs.sparkSession)
    return common.mapped(docs, run, columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
