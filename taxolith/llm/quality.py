"""Quality: learned vectors of hashed words and character n-grams, averaged per document, and a softmax over the average.

A text is cut into words at white space and other ASCII control bytes. Its features are each word as a whole, each run of
3, 4 or 5 bytes of a word (a blank at its ends marks where it begins and ends), and one marker for a word that equals the
one before it; all are hashed to 2 ** `BITS` vectors of `WIDTH` numbers. A text's vector is half the mean over its words
and half the mean over its runs, repeats included, and two softmax outputs on it give the chance of good quality.

The fit draws a bounded sample: at most `FIT_ROWS` labelled keys of each class, in the order of a hash, one text a key; the
driver gets the weight of each vector in each of these texts (at most 2 * FIT_ROWS * 2 ** BITS pairs of 6 bytes, in practice
a few thousand a text). Training is stochastic gradient descent, one text a step, classes in turn, with a falling rate; a
step moves the text's average by the rate whatever its length. As outputs are linear in the vectors, scoring reads a table
of one number a bucket. It runs over every byte of every text inside map tasks.

Defined cases: null, empty and blank texts get the score of the output's bias alone; repeated rows score alike, row by row;
keys with several labels are bad if any label is 0; a key with several texts gives the one that a hash puts first; null
labels and null keys are not learned from; with one class or none to learn from, every score is the share of good rows (1
if there are none); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

BITS = 16
WIDTH = 8
ORDERS = (3, 4, 5)
#: Labelled keys of each class that the fit reads at most.
FIT_ROWS = 800
EPOCHS = 12
RATE = 0.5
FOLDS = 5
KEEP = 0.3
AGAIN = 0  # the bucket of the marker for a repeated word


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(row, bucket, whether they are words) of every feature, repeats included, in some parts."""
    n = len(at) - 1
    shift = 2 * np.arange(n + 1) + 1
    rows = np.repeat(np.arange(n), np.diff(at))
    text = np.full(len(data) + 2 * n, 32, np.uint8)  # a blank before and after each text
    text[np.arange(len(data)) + shift[rows]] = np.maximum(data, 32)
    row = np.repeat(np.arange(n), np.diff(at) + 2)
    blank = np.concatenate([[0], np.cumsum(text == 32)])
    inside = text != 32
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(start):
        return
    code = common.SpanHash(text, 4).of(start, end)
    own = row[start]
    yield own, _bucket(code), True
    again = np.flatnonzero((code[1:] == code[:-1]) & (own[1:] == own[:-1])) + 1
    yield own[again], np.full(len(again), AGAIN), True
    rolled = text.astype(np.uint64)
    value = rolled
    for k in range(2, max(ORDERS) + 1):
        value = value[:-1] * np.uint64(0x100000001B3) + rolled[k - 1 :]
        if k in ORDERS:
            whole = np.flatnonzero(blank[k - 1 : k - 1 + len(value)] == blank[1 : 1 + len(value)])  # no blank between the ends
            yield row[whole], _bucket(common.mixed(value[whole] + np.uint64(k << 56))), False


def _bucket(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def averages(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the vectors that make up each text's vector, by row and bucket; a row's weights sum to 1,
    but for the marker's."""
    n = len(at) - 1
    parts = list(features(data, at))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    each = _each(parts, n)
    key, place = np.unique(np.concatenate([r << BITS | b for r, b, _ in parts]), return_inverse=True)
    weight = np.bincount(place, np.concatenate([each[kind][r] for r, _, kind in parts]))
    return key >> BITS, key & ((1 << BITS) - 1), weight


def _each(parts: list, n: int) -> dict[bool, np.ndarray]:
    """What one word, and one run of bytes, weighs in each row."""
    words = np.bincount(parts[0][0], minlength=n)
    runs = sum(np.bincount(r, minlength=n) for r, _, kind in parts if not kind)
    return {True: 0.5 / np.maximum(words, 1), False: 0.5 / np.maximum(runs, 1)}


@dataclass
class Model:
    vectors: np.ndarray  # buckets x WIDTH
    out: np.ndarray  # WIDTH x 2
    bias: np.ndarray

    def table(self) -> np.ndarray:
        """What a bucket's vector adds to the difference of the two outputs."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)

    def score(self, data: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
        n = len(at) - 1
        parts = list(features(data, at))
        total = np.full(n, float(self.bias[1] - self.bias[0]))
        if parts:
            each = _each(parts, n)
            for row, bucket, kind in parts:
                total += each[kind] * np.bincount(row, table[bucket], n)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def learned(texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 11) -> Model:
    """texts: buckets and weights; y: 0 or 1. Classes take turns, so they weigh the same."""
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, WIDTH)) - 0.5) / WIDTH
    out, bias = np.zeros((WIDTH, 2)), np.zeros(2)
    by_class = [np.flatnonzero(y == k) for k in (0, 1)]
    steps = EPOCHS * max(map(len, by_class))
    order = [np.concatenate([rng.permutation(own) for _ in range(-(-steps // len(own)))])[:steps] for own in by_class]
    done = 0
    for pair in zip(*order, strict=True):
        for k, row in enumerate(pair):
            rate = RATE * (1 - done / (2 * steps))
            done += 1
            bucket, weight = texts[row]
            hidden = weight @ vectors[bucket]
            z = hidden @ out + bias
            e = np.exp(z - z.max())
            error = -e / e.sum()
            error[k] += 1
            back = out @ error
            out += rate * np.outer(hidden, error)
            bias += rate * 0.1 * error
            if len(bucket):
                vectors[bucket] += rate * np.outer(weight / (weight @ weight), back)
    return Model(vectors, out, bias)


def constant(share: float) -> Model:
    odds = float(np.clip(np.log(max(share, 1e-18) / max(1 - share, 1e-18)), -40, 40))
    return Model(np.zeros((1 << BITS, WIDTH)), np.zeros((WIDTH, 2)), np.array([0.0, odds]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality, text): one row a chosen key, whatever number of rows the documents have of it."""
    marked = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
        .where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marked.where("quality = 1").orderBy(*order).limit(rows).unionByName(marked.where("quality <> 1").orderBy(*order).limit(rows))
    found = common.documents(docs).join(F.broadcast(chosen), "doc_id")  # 2 * rows short rows
    return found.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "text"):
        row, bucket, weight = averages(*common.raw(batch.column("text")))
        cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
        sides = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (bucket.astype(np.uint16), weight.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *(pa.array(s, pa.binary()) for s in sides)], ["doc_id", "quality", "buckets", "weights"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    got = sorted(common.mapped(sample(docs, labels, rows), _weighed, "doc_id long, quality int, buckets binary, weights binary").collect(), key=lambda r: r.doc_id)
    y = np.array([int(r.quality == 1) for r in got])
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 1.0)
    return learned([(np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.weights, np.float32).astype(np.float64)) for r in got], y)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of docs."""
    table, bias = model.table(), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(None, None, bias)  # the table is all that scoring needs
        for batch in common.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.score(*common.raw(batch.column("text")), table))], ["doc_id", "score"])

    return common.mapped(common.documents(docs), run, "doc_id long, score double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= KEEP).cast("int").alias("predicted"),
    )
