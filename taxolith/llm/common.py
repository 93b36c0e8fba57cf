"""Shared helpers: whole-text access over Arrow batches and written tables in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.sources.io import shared_folder

CHUNK_BYTES = 1 << 18
BATCH_ROWS = 1000
#: Tasks that a hot key's rows are dealt to by `spread_join`.
SALTS = 64


def tune(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small enough for a worker: rows are wide here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        spark, path = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow; a worker gives the memory of its arrays back when a task ends, as it lives on for other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return df.mapInArrow(task, schema)


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """rows.join(table, key, "left") for a table of one row a key, where a key may hold a large share of the rows: they
    are dealt to SALTS tasks by a hash of the column `by`, and a table row goes only to those that have rows of its key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    places = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(places, [key, "_salt"], "left").drop("_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, whatever else the table holds; a null text is an empty one."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and its row bounds (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, bounds, data = column.buffers()
    if n == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + most, "right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of 64-bit values (a finaliser of multiply and shift steps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    return _powers(base, 2 * CHUNK_BYTES)[: max(n, 1)] if n <= 2 * CHUNK_BYTES else _powers.__wrapped__(base, n)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class SpanHash:
    """Hashes of any spans of one byte array from prefix sums: sum of code(byte) * base ** position, modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 40, 1 << 62)) | 5
        self._sum(rng.integers(1, 1 << 63, 256, dtype=np.uint64)[data], base)

    @classmethod
    def of_codes(cls, codes: np.ndarray, base: int = 0x3C6EF372FE94F82D):
        """The same over an array of 64-bit codes."""
        own = cls.__new__(cls)
        own._sum(codes, base)
        return own

    def _sum(self, codes: np.ndarray, base: int) -> None:
        n = len(codes)
        self.back = powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * powers(base, n)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))
