"""Language ID: a byte convolutional network, trained in numpy on labelled text.

A text's UTF-8 bytes are cut into windows of `WINDOW` bytes (the last one padded with zeros). Filters of several widths
slide over embedded bytes, the largest response of each filter in a window is kept, and a softmax layer turns these
into language probabilities; a text's are the mean over all its windows, by their bytes. The fit reads a bounded sample of labelled
rows (about `FIT_ROWS` a language, by a hash of the key) and `FIT_WINDOWS` windows of each; scoring reads every byte of
every text in map tasks, with embedding and filters folded into one table per filter place.

Defined cases: null texts and texts without a letter are `und` with score 0, as is every text if nothing can be learned;
equal texts get equal results; ties go to the language that sorts first; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
FIT_ROWS = 400
FIT_WINDOWS = 12
STEPS = 1200
BATCH = 96
FOLDS = 3
SLICE = 512  # windows at a time
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}").search


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, each window's row and its number of bytes."""
    length = np.diff(at)
    count = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = at[row] + number * WINDOW
    size = np.minimum(at[row + 1] - start, WINDOW)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    out = np.where(np.arange(WINDOW) < size[:, None], out, 0).astype(np.uint8)
    return out, row, size


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDED
    filters: list[np.ndarray]  # width x EMBEDDED x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(languages, draw(256, EMBEDDED, scale=0.5), [draw(w, EMBEDDED, FILTERS, scale=(w * EMBEDDED) ** -0.5) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw(n, len(languages), scale=n**-0.5), np.zeros(len(languages), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """Embedding and filter in one: what each byte adds at each place of each width."""
        return [[self.embedding @ f[j] + (b if j == 0 else 0) for j in range(len(f))] for f, b in zip(self.filters, self.bias, strict=True)]

    @staticmethod
    def pooled(batch: np.ndarray, tables: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The largest response of each filter in each window, and where it is."""
        best, where = [], []
        for table in tables:
            n = WINDOW - len(table) + 1
            response = table[0][batch[:, :n]]
            for j in range(1, len(table)):
                response += table[j][batch[:, j : j + n]]
            where.append(response.argmax(1))
            best.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
        return np.maximum(np.concatenate(best, 1), 0), where

    def probabilities(self, batch: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        best = []
        for table in tables:
            n = WINDOW - len(table) + 1
            response = np.take(table[0], batch[:, :n], axis=0)
            for j in range(1, len(table)):
                response += np.take(table[j], batch[:, j : j + n], axis=0)
            best.append(response.max(1))
        return softmax(np.maximum(np.concatenate(best, 1), 0) @ self.out + self.out_bias)

    def gradient(self, batch: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        best, where = self.pooled(batch, self.tables())
        error = softmax(best @ self.out + self.out_bias)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ self.out.T) * (best > 0)
        g_embedding = np.zeros_like(self.embedding)
        g_filters, g_bias = [], []
        line = np.arange(len(y))[:, None]
        for k, w in enumerate(WIDTHS):
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(self.filters[k])
            for j in range(w):
                seen = batch[line, where[k] + j]  # windows x filters
                g[j] = np.einsum("bfe,bf->ef", self.embedding[seen], own)
                np.add.at(g_embedding, seen.ravel(), (own[:, :, None] * self.filters[k][j].T[None]).reshape(-1, EMBEDDED))
            g_filters.append(g)
            g_bias.append(own.sum(0))
        return [g_embedding, *g_filters, *g_bias, best.T @ error, error.sum(0)]

    def train(self, data: np.ndarray, y: np.ndarray, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        weights = self.weights()
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        share = 1 / np.bincount(y, minlength=len(self.languages))[y]
        chance = share / share.sum()
        for step in range(1, STEPS + 1):
            pick = rng.choice(len(y), BATCH, p=chance)
            keep = np.where(rng.random(BATCH) < 0.5, rng.integers(8, WINDOW, BATCH), WINDOW)  # short texts too
            batch = np.where(np.arange(WINDOW) < keep[:, None], data[pick], 0).astype(np.uint8)
            rate = 0.01 * (1 - step / (STEPS + 1)) / (1 - 0.9**step)
            for w, g, a, b in zip(weights, self.gradient(batch, y[pick]), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * a / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "text"):
        out, row, size = windows(*common.raw(batch.column("text")))
        good = (size >= 16) | (np.bincount(row, minlength=batch.num_rows)[row] == 1)
        out, row = out[good], row[good]
        spread = common.mixed(np.arange(len(row)).astype(np.uint64) + row.astype(np.uint64) * np.uint64(977))
        order = np.lexsort((spread, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row = order[rank < FIT_WINDOWS], row[rank < FIT_WINDOWS]
        yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row)), pa.array([w.tobytes() for w in out[order]], pa.binary())], ["lang", "piece"])


def fit(docs: DataFrame) -> Network | None:
    """Learn from rows with text and language whose crc32(key) mod FOLDS is not 1."""
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 1)
    counts = {r.lang: r["count"] for r in learn.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    common.tune(docs.sparkSession)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, FIT_ROWS / n))])
    chosen = learn.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row a key, however many it has
    got = common.mapped(chosen.select("text", "lang"), _sample_windows, "lang string, piece binary").collect()
    languages = sorted({r.lang for r in got})
    if not languages:
        return None
    rows = sorted((languages.index(r.lang), bytes(r.piece)) for r in got)
    network = Network.fresh(languages)
    network.train(np.frombuffer(b"".join(p for _, p in rows), np.uint8).reshape(-1, WINDOW), np.array([k for k, _ in rows]))
    return network


def identified(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.tables() if network else []
        for batch in common.chunks(batches, "text"):
            n = batch.num_rows
            predicted, score = [UNKNOWN] * n, np.zeros(n)
            if network:
                pieces, row, size = windows(*common.raw(batch.column("text")))
                total = np.zeros((n, len(network.languages)))
                for a in range(0, len(pieces), SLICE):
                    p = network.probabilities(pieces[a : a + SLICE], tables) * size[a : a + SLICE, None]
                    for k in range(p.shape[1]):
                        total[:, k] += np.bincount(row[a : a + SLICE], p[:, k], n)
                total /= np.maximum(total.sum(1, keepdims=True), 1e-12)
                best = total.argmax(1).tolist()
                for k, text in enumerate(batch.column("text").to_pylist()):
                    if LETTER(text):
                        predicted[k], score[k] = network.languages[best[k]], min(1.0, total[k, best[k]])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(predicted), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return common.mapped(common.documents(docs), run, "doc_id long, lang_pred string, score double")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identified(docs, fit(docs)).select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 1).alias("held_out"), "lang_pred", "score")
