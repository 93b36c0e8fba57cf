"""Packing: concatenate and cut. Two passes of prefix sums give every document its place in one endless run of ids.

Pass one turns each text into ids once, inside its map task, and writes them with the task's number and the place
within the task. The tasks' totals (one row a task) are summed up to offsets; pass two adds a task's offset to the
place, and cuts at each multiple of the sequence length. What remains after the last full sequence is cut into
sequences whose lengths are powers of two, so nothing is padded. No row moves between tasks.

Defined cases: null and empty texts are the end id alone; repeated rows are packed one by one; a text longer than a
sequence spans several; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import bpe, common

LENGTH = 4096
END_ID = 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, place (ids before it in its part), n (with the end id), ids (two bytes each, without it); written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.loaded(bpe.WordIds, path)
        place, part = 0, TaskContext.get().partitionId()
        for batch in common.chunks(batches, "text", bpe.SLICE):
            flat, counts = model.ids(batch.column("text").to_pylist())
            n = counts + 1
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            cuts = np.concatenate([[0], np.cumsum(2 * counts)]).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
            columns = [batch.column("doc_id"), pa.array([part] * len(n), pa.int64()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), ids]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "place", "n", "ids"])

    return common.written(common.mapped(common.documents(docs, id_col, text_col), run, "doc_id long, part long, place long, n long, ids binary"), "ids")


def bounds_of_rest(total: int, length: int) -> list[int]:
    """Where the sequences after the last full one begin: the rest's binary digits, largest first."""
    start = total - total % length
    out = []
    for bit in reversed(range(length.bit_length())):
        if (total % length) >> bit & 1:
            out.append(start)
            start += 1 << bit
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    spark = docs.sparkSession
    ids = encoded(docs, path)
    totals = sorted((r.part, r.n) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a task
    offsets = list(accumulate((n for _, n in totals), initial=0))
    total = offsets.pop()
    rest = np.array(bounds_of_rest(total, length), np.int64)
    before = spark.createDataFrame([(p, o) for (p, _), o in zip(totals, offsets, strict=True)], "part long, before long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = total - total % length
        for batch in batches:
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "first", "n", "ids"))
            for doc, first, n, body in zip(*columns, strict=True):
                whole = np.append(np.frombuffer(body, np.uint16), end_id).astype("<u4")
                at = 0
                while at < n:
                    g = first + at
                    if g < full:
                        sequence, offset, end = g // length, g % length, min(g - g % length + length, full)
                    else:
                        k = int(np.searchsorted(rest, g, "right")) - 1
                        sequence, offset = full // length + k, g - int(rest[k])
                        end = int(rest[k + 1]) if k + 1 < len(rest) else total
                    size = min(n - at, end - g)
                    rows.append((doc, at, size, zlib.crc32(whole[at : at + size].tobytes()), n, sequence, offset))
                    at += size
            if rows:
                names = [x.split()[0] for x in PIECE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    placed = ids.join(before.hint("broadcast") if len(totals) < 1_000_000 else before, "part")
    return common.mapped(placed.select("doc_id", (F.col("before") + F.col("place")).alias("first"), "n", "ids"), cut, PIECE)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
