"""Document fingerprints: a quartile bucket digest of hashed byte triplets, and a bounded difference score.

Six triplets of every window of five bytes are hashed into `BUCKETS` counters. The quartiles of the counters turn each
counter into two bits; with a checksum byte, a logarithmic length byte and the ratios of the quartiles they make the
digest. Two digests differ by the steps between their buckets (an extreme step weighs 6), between their lengths and
their ratios; the likeness is 1 - min(difference, BOUND) / BOUND.

To meet the next document, rows are dealt by ranges of descending keys and sorted within them, so a task reads each
text once and sees nearly every neighbour; the last text of a task and the first of the next one are carried in two
rows a task and met in a small second step.

Defined cases: null and empty texts have the digest of no triplets; equal texts have equal digests; rows of one key are
ordered by text, a null key comes last; a single row is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

BUCKETS = 128
BOUND = 300
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))
STEP = np.array([0, 1, 2, 6], np.int64)
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of bytes for each text: checksum, length, two ratios, bucket codes."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate([[0], np.cumsum(lengths)])
    rows = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    base = rows * np.int32(BUCKETS)
    counts = np.zeros(len(texts) * BUCKETS, np.int64)
    for k, (i, j, m) in enumerate(TRIPLETS):
        n = len(data) - m
        if n <= 0:
            continue
        h = data[i : i + n] * np.uint32(0x9E3779B1) + data[j : j + n] * np.uint32(0x85EBCA77) + data[m : m + n] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        key = base[:n] + (h >> np.uint32(25)).astype(np.int32)
        whole = rows[:n] == rows[m:]
        counts += np.bincount(key if whole.all() else key[whole], minlength=len(counts))
    counts = counts.reshape(-1, BUCKETS)
    ordered = np.sort(counts, 1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    length = np.floor(np.log(np.maximum(lengths, 1)) / np.log(1.1)).astype(np.int64) & 255
    third = np.maximum(q3[:, 0], 1)
    ratios = np.minimum(q1[:, 0] * 15 // third, 15), np.minimum(q2[:, 0] * 15 // third, 15)
    sums = np.concatenate([[0], np.cumsum(data, dtype=np.uint64)]).astype(np.int64)
    check = ((sums[at[1:]] - sums[at[:-1]]) * 31 + lengths) & 255
    return np.concatenate([np.stack([check, length, ratios[0] << 4 | ratios[1]], 1).astype(np.uint8), packed.astype(np.uint8)], 1)


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 2).reshape(len(packed), -1).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 at a difference of BOUND or more."""
    gap = STEP[np.abs(unpacked(a[:, 3:]) - unpacked(b[:, 3:]))].sum(1)
    around = np.abs(a[:, 1].astype(np.int64) - b[:, 1])
    around = np.minimum(around, 256 - around)
    gap += np.where(around <= 1, around, 12 * (around - 1))
    for shift in (4, 0):
        ratio = np.abs((a[:, 2] >> shift & 15).astype(np.int64) - (b[:, 2] >> shift & 15))
        gap += np.where(ratio <= 1, ratio, 12 * (ratio - 1))
    gap += a[:, 0] != b[:, 0]
    return 1 - np.minimum(gap, BOUND) / BOUND


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def answers(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """FIELDS for rows and the texts that follow them."""
    mine, changed = [t.encode() for t in texts], [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    own, new = digests(mine), digests(changed)
    later = own[1:] if following[:-1] == texts[1:] else None
    last = digests([following[-1].encode()])
    nxt = np.concatenate([later, last]) if later is not None else digests([f.encode() for f in following])
    columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed])]
    columns += [pa.array([d.tobytes().hex() for d in x]) for x in (own, new)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(likeness(own, new)), pa.array(likeness(own, nxt))], [x.split()[0] for x in FIELDS.split(", ")])


def _with(batch: pa.RecordBatch, kind: int, part: int, texts: list[str] | None = None) -> pa.RecordBatch:
    n = batch.num_rows
    new = [pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(texts or [None] * n, pa.string())]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "kind", "part", "text"])


def _edge(doc, text: str, kind: int, part: int) -> pa.RecordBatch:
    empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
    return _with(pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), *empty], [x.split()[0] for x in FIELDS.split(", ")]), kind, part, [text])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: answered rows; kind 1: the task's first text, for the task before; kind 2: its last row, still open."""
    part, open_ = TaskContext.get().partitionId(), None
    for batch in common.chunks(batches, "text"):
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if open_ is None:
            yield _edge(ids[0], texts[0], 1, part)
        else:
            ids, texts = [open_[0], *ids], [open_[1], *texts]
        open_ = ids[-1], texts[-1]
        if len(ids) > 1:
            yield _with(answers(ids[:-1], texts[:-1], texts[1:]), 0, part)
    if open_ is not None:
        yield _edge(*open_, 2, part)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield answers([doc], [text], [following])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FIELDS for every row: its digest, that of its edited text, and its likeness to that and to the next row."""
    spark = docs.sparkSession
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    ranged = common.documents(docs, id_col, text_col).repartitionByRange(order[0]).sortWithinPartitions(*order)
    found = common.written(common.mapped(ranged, _local, FIELDS + ", kind int, part long, text string"), "digests")
    parts = sorted(r.part for r in found.where("kind = 1").select("part").collect())  # one row a task
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, after long")
    heads = found.where("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    open_ = found.where("kind = 2").select("doc_id", "part", "text").join(after, "part").join(heads, "after")
    columns = [x.split()[0] for x in FIELDS.split(", ")]
    return found.where("kind = 0").select(columns).unionByName(common.mapped(open_.select("doc_id", "text", "following"), _close, FIELDS))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
