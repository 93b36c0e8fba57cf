"""N-gram counts, vocabularies and pruning."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxolith.functions import tokens as N
from taxolith.operators import features
from taxolith.sources.io import stored

#: Tokens whose n-grams are counted at a time, and rows that are given back at a time.
SLICE, ROWS = 3 << 19, 1 << 16


def ngram_counts(df: DataFrame, text_col: str, label: str | None = None, low: int = 1, high: int = 1, min_count: int = 1, min_classes: int = 0) -> DataFrame:
    """ngram, n, doc_count, n_classes. A null label counts as a class of its own.

    Texts are dealt to as many tasks as they fill buckets of `features.BUCKET` bytes, which count n-grams as numbers: what
    moves is a row per n-gram and label of a task's texts, not one per text. These rows meet by n-gram, in as many tasks, and
    labels are counted where they lie. So no task's table or output grows with the texts, however large the files' parts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, texts in _slices(batches):
            yield from _counted(labels, texts, low, high)

    n = features.buckets(df, text_col)
    texts = df.select(F.coalesce(F.col(label).cast("string"), F.lit("\0")).alias("_l") if label else F.lit("").alias("_l"), F.col(text_col).alias("_t")).repartition(n)
    pairs = texts.withColumn("_t", N.tokenize(F.col("_t"))).mapInArrow(run, "ngram string, _l string, _n long").repartition(n, "ngram").groupBy("ngram", "_l").agg(F.sum("_n").alias("_n"))
    out = pairs.groupBy("ngram").agg(F.sum("_n").alias("doc_count"), F.count("*").alias("n_classes"))
    out = out.select("ngram", (F.size(F.split("ngram", " "))).alias("n"), "doc_count", "n_classes" if label else F.lit(0).cast("long").alias("n_classes"))
    return out.where((F.col("doc_count") >= min_count) & (F.col("n_classes") >= min_classes))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Labels and token lists of whole texts that hold about `SLICE` tokens; a longer text is a slice of its own."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(int(np.searchsorted(ends, before + SLICE - n, "right")), start + (not held))
            if end > start:
                held.append(batch.slice(start, end - start))
                n += int(ends[end - 1] - before)
            if end < batch.num_rows:
                yield _joined(held)
                held, n = [], 0
            start = end
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return pa.concat_arrays([p.column(0) for p in parts]), pa.concat_arrays([p.column(1) for p in parts])


def _counted(labels: pa.Array, texts: pa.Array, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """ngram, _l, _n: how many of the texts of a label have an n-gram."""
    label = labels.dictionary_encode()
    count = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(count)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(text))  # tokens from here to the text's end
    tokens = texts.flatten().dictionary_encode()
    token, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
    gram, names = token, words
    for n in range(1, high + 1):
        if n > 1:  # each shorter n-gram with the token after it
            at = np.flatnonzero(left >= n)
            both = pa.array(gram[at] * max(len(words), 1) + token[at + n - 1]).dictionary_encode()
            first, last = np.divmod(both.dictionary.to_numpy(), max(len(words), 1))
            names = pc.binary_join_element_wise(names.take(pa.array(first)), words.take(pa.array(last)), " ")
            gram = np.full(len(text), -1)
            gram[at] = both.indices.to_numpy()
        if n >= low:
            own = np.flatnonzero(left >= n)
            row, place = np.divmod(np.unique(text[own] * max(len(names), 1) + gram[own]), max(len(names), 1))
            pairs, times = np.unique(place * max(len(label.dictionary), 1) + label.indices.to_numpy()[row], return_counts=True)
            for a in range(0, len(pairs), ROWS):
                place, of = np.divmod(pairs[a : a + ROWS], len(label.dictionary))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(place)), label.dictionary.take(pa.array(of)), pa.array(times[a : a + ROWS])], ["ngram", "_l", "_n"])


def token_report(counts: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """threshold, kept, share, median_classes: what stays of ngram_counts by least document count."""
    aggs = [F.struct(F.lit(t).alias("threshold"), F.count_if(F.col("doc_count") >= t).alias("kept"), F.percentile(F.when(F.col("doc_count") >= t, F.col("n_classes")), F.lit(0.5)).alias("median_classes")) for t in thresholds]
    row = counts.agg(F.count("*").alias("total"), F.array(*aggs).alias("x"))
    return row.select("total", F.explode("x").alias("x")).select("x.threshold", "x.kept", (F.col("x.kept") / F.greatest("total", F.lit(1))).alias("share"), "x.median_classes")


def keep_vocabulary(train: DataFrame, text_col: str, min_count: int, min_classes: int = 0, label: str | None = None) -> DataFrame:
    """token: those of the training rows in enough documents and classes."""
    return ngram_counts(train, text_col, label, min_count=min_count, min_classes=min_classes).select(F.col("ngram").alias("token"))


def pruned(df: DataFrame, key: str, text_col: str, vocabulary: DataFrame) -> DataFrame:
    """Texts reduced to the vocabulary's tokens, in order; all rows stay. For key values that are unique."""

    def run(own: features.Met) -> Mapping[str, pa.Array]:
        order = np.argsort(own.order[0], kind="stable")
        there, first = np.unique(own.order[0][order], return_index=True)
        words = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), own.names.take(pa.array(own.order[1][order])))
        return {key: own.keys.take(pa.array(there)), "_kept": pc.binary_join(words, " ")}

    known = vocabulary.select(F.col("token").alias("feature"))
    kept = features.met(df.where(F.col(key).isNotNull()), key, text_col, features.Features("count"), known, run, f"`{key}` {dict(df.dtypes)[key]}, _kept string")
    out = df.drop(text_col).join(kept, key, "left").withColumn(text_col, F.coalesce("_kept", F.lit("")))
    return out.select(*[f"`{c}`" for c in df.columns])


def drop_rare_tokens(train: DataFrame, others: Sequence[DataFrame], key: str, text_col: str, min_count: int, min_classes: int = 0, label: str | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """All splits pruned by the training rows' counts; untouched if nothing is asked for."""
    if min_count <= 1 and min_classes <= 0:
        return train, list(others), None
    vocabulary = stored(keep_vocabulary(train, text_col, min_count, min_classes, label), "vocabulary")
    return pruned(train, key, text_col, vocabulary), [pruned(o, key, text_col, vocabulary) for o in others], vocabulary


def token_index(df: DataFrame, text_col: str, most: int = 16000, min_df: int = 2) -> DataFrame:
    """token, df, index: by document frequency, ties by name; 0 is padding and 1 is unknown.

    The window runs over at most `most` rows, which the limit has chosen in parallel."""
    counts = df.select(F.explode(F.array_distinct(N.tokenize(F.col(text_col)))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    top = counts.orderBy(F.desc("df"), "token").limit(most)
    return top.withColumn("index", F.row_number().over(W.orderBy(F.desc("df"), "token")) + 1)


def encoded(df: DataFrame, key: str, text_col: str, index: DataFrame) -> DataFrame:
    """key, ids: a text's known tokens as numbers, in order; [1] if there are none."""
    tokens = df.select(key, F.posexplode(N.tokenize(F.col(text_col))).alias("_p", "token"))
    known = tokens.join(index.select("token", "index"), "token").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "index"))), lambda x: x["index"]).alias("ids"))
    return df.select(key).join(known, key, "left").select(key, F.coalesce("ids", F.array(F.lit(1))).alias("ids"))


def oov_rate(df: DataFrame, text_col: str, index: DataFrame) -> DataFrame:
    """One row: the share of tokens that are not in the index; 0 without tokens."""
    counts = df.select(F.explode(N.tokenize(F.col(text_col))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    hit = counts.join(index.select("token", F.lit(1).alias("hit")), "token", "left")
    return hit.agg(F.coalesce(1 - F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), F.lit(0.0)).alias("oov_rate"))
