"""Readers and writers. All columns of delimited files are text: nothing is inferred, so leading zeros stay."""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from taxolith.functions import text as T
from taxolith.operators.filters import check_columns

#: Names of a key column in a list of keys (fixed values).
ID_NAMES = ("id", "item id", "item_id", "itemid", "product id", "product_id", "sku", "product", "product number")
#: Special files in a folder of word lists (fixed values).
SPECIAL_LISTS = ("abbrevs_to_expand", "to_normalize", "good_tokens")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the driver and all executors share. Where none is set, a temporary folder
    serves a local session; a cluster's executors would not see each other's files there, so that is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def read_delimited(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sep: str = "|") -> DataFrame:
    """All columns as text; with `columns` the schema is fixed and no file is opened while planning."""
    reader = spark.read.option("sep", sep).option("header", True).option("inferSchema", False)
    if columns:
        reader = reader.schema(Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns]))
    return reader.csv(path)


def read_table(spark: SparkSession, source: str, kind: str = "parquet") -> DataFrame:
    """kind: parquet, delta (if its package is there), table, sql or csv; columns become text."""
    if kind == "table":
        return as_text(spark.table(source))
    if kind == "sql":
        return as_text(spark.sql(source))
    if kind == "csv":
        return read_delimited(spark, source)
    return as_text(spark.read.format(kind).load(source))


def load(spark: SparkSession, source: str, kind: str, needed: Sequence[str]) -> DataFrame:
    return check_columns(read_table(spark, source, kind), needed)


def write_delimited(df: DataFrame, path: str, sep: str = "|", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).csv(path)


def _first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).where(F.trim("value") != "").first()
    return row.value.lstrip("﻿") if row else ""


def _header(names: list[str], column: str | None) -> str | None:
    low = {n.strip().lower(): n for n in names}
    if column is not None:
        if column.strip().lower() not in low:
            raise ValueError(f"column {column!r} is not among {names}")
        return low[column.strip().lower()]
    return next((low[x] for x in ID_NAMES if x in low), None)


def read_ids(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """id: the distinct keys of a delimited file. The separator (comma, tab or bar) and a header are found from the
    first line; quotes, a byte order mark, blanks and repeats are dealt with."""
    first = _first_line(spark, path)
    sep = max((",", "\t", "|"), key=first.count)
    names = next(csv.reader([first], delimiter=sep), [])
    head = _header(names, column)
    raw = spark.read.option("sep", sep).option("header", False).option("quote", '"').schema(Ty.StructType([Ty.StructField(f"_{k}", Ty.StringType()) for k in range(max(len(names), 1))])).csv(path)
    place = names.index(head) if head else 0
    value = T.strip(F.regexp_replace(F.col(f"_{place}"), "^﻿", ""))
    out = raw.select(value.alias("id")).where("id is not null and id <> ''").distinct()
    return out.where(F.lower("id") != head.strip().lower()) if head else out


def read_words(spark: SparkSession, folder: str) -> DataFrame:
    """list, term: a file a list, named by it; each file's first line is a header. Special files are left out.

    A line's place in its file is its start's, so the header is the line at place 0 of a whole-file read."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.\w+)?$", 1).alias("list"), "value")
    files = files.select("list", F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n").alias("lines"))
    lines = files.select("list", F.explode(F.slice("lines", F.lit(2), F.size("lines"))).alias("term"))
    return lines.select("list", T.strip(F.col("term")).alias("term")).where(F.col("term") != "").where(~F.lower("list").isin(*SPECIAL_LISTS))


def word_lists(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """The lists as values; they are vocabularies of a cleaning recipe, a few kilobytes."""
    out: dict[str, list[str]] = {}
    for r in read_words(spark, folder).collect():
        out.setdefault(r.list, []).append(r.term)
    if not out:
        raise ValueError(f"no word lists in {folder}")
    return out


def read_pairs(spark: SparkSession, path: str, required: bool = True, blank_to: bool = False) -> dict[str, str]:
    """A two-column map in upper case: find, replace. blank_to allows an empty replacement. An absent file is an error
    if it is required, else an empty map."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        if required:
            raise FileNotFoundError(path)
        return {}
    schema = Ty.StructType([Ty.StructField("k", Ty.StringType()), Ty.StructField("v", Ty.StringType())])
    rows = spark.read.option("header", True).schema(schema).csv(path).select(F.upper(T.strip(F.col("k"))).alias("k"), F.upper(T.strip(F.coalesce("v", F.lit("")))).alias("v")).where("k <> ''").collect()
    if not blank_to and (bad := [r.k for r in rows if r.v == ""]):
        raise ValueError(f"no replacement for {bad}")
    return {r.k: r.v for r in rows}


def read_tokens(spark: SparkSession, path: str, column: str = "token", upper: bool = True) -> DataFrame:
    """One column of distinct tokens; the first line is a header."""
    rows = spark.read.option("header", True).schema(f"{column} string").csv(path).select(T.strip(F.col(column)).alias(column))
    return rows.withColumn(column, F.upper(column) if upper else F.lower(column)).where(F.col(column) != "").distinct()


def english_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line, in lower case."""
    return spark.read.text(path).select(F.lower(T.strip(F.col("value"))).alias("word")).where("word <> ''").distinct()


def write_counts(counts: DataFrame, path: str, kind: str = "parquet", options: Mapping[str, str] | None = None) -> None:
    counts.write.mode("overwrite").options(**(options or {})).format(kind).save(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: what several steps read is worked out once, and its size is known."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
