"""Continuous scoring: the batch plan has no shuffle and no state, so it runs unchanged on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from taxolith.plans.score import score
from taxolith.sources.bundle import Bundle


def arriving(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder; the schema is fixed, and a trigger reads a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def scored_stream(stream: DataFrame, bundle: Bundle, **how) -> DataFrame:
    return score(stream, bundle, **how)


def start(stream: DataFrame, bundle: Bundle, out: str, checkpoint: str, once: bool = False, **how) -> StreamingQuery:
    """Appends scores to a folder; what is done is remembered in the checkpoint folder."""
    writer = scored_stream(stream, bundle, **how).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
