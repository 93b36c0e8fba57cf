"""Texts over a term table that stays in Spark, and models whose weights are a table of terms by blocks of classes.

A vocabulary without a cap grows with the texts, so neither the driver nor a plan holds it: terms are counted, chosen and
numbered as rows, and texts meet them in joins. Weights are rows (feature, block, w): the numbers of `BLOCK` classes each,
written where all tasks can read them. Texts are dealt by key to buckets, a bucket asks for each of its terms once
(`features.met`), and what a text meets is summed in its bucket, block by block: no occurrence of a term moves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.functions import tokens as N
from taxolith.operators import features, splits
from taxolith.operators.features import Features
from taxolith.operators.hierarchy import Tree
from taxolith.sources.io import stored

BLOCK = 64
#: Weights that are sent whole to every task, at most.
NUMBERS = 1 << 21
#: Rows of weights that are written at a time.
ROWS = 1 << 14
#: The block of a term's own row: that it is known, whatever class has it. Its w is null if the term has other rows, which tell as much, else empty.
KNOWN = -1
EMPTY = "struct(cast(array() as array<int>) as places, cast(array() as array<double>) as values)"


def term_table(df: DataFrame, key: str, text_col: str, how: Features) -> DataFrame:
    """feature, place, df of the features that `how` selects, numbered from 0 in the order of a hash."""
    chosen = stored(features.selected(features.term_counts(df, key, text_col, how), df.count(), how), "chosen")
    numbered = splits.ranked(chosen.withColumn("_all", F.lit("")), "_all", "feature", 0)
    return stored(numbered.select("feature", (F.col("_rank") - 1).cast("int").alias("place"), "df"), "terms")


def sparse_rows(df: DataFrame, key: str, text_col: str, how: Features, terms: DataFrame, out: str = "features") -> DataFrame:
    """df with a struct of places and values (counts), places ascending; texts without known terms have empty ones."""

    def run(own: features.Met) -> Mapping[str, pa.Array]:
        place = own.column("place").astype(np.int32)[own.term]
        order = np.lexsort((place, own.row))
        there, first = np.unique(own.row, return_index=True)
        at = pa.array(np.append(first, len(place)), pa.int32())
        places, values = (pa.ListArray.from_arrays(at, pa.array(x[order], kind)) for x, kind in ((place, pa.int32()), (own.tf, pa.float64())))
        return {key: own.keys.take(pa.array(there)), out: pa.StructArray.from_arrays([places, values], ["places", "values"])}

    packed = features.met(df.where(F.col(key).isNotNull()), key, text_col, how, terms.select("feature", "place"), run, f"`{key}` {dict(df.dtypes)[key]}, `{out}` struct<places: array<int>, values: array<double>>")
    return df.join(packed, key, "left").withColumn(out, F.coalesce(out, F.expr(EMPTY)))


def known_tokens(df: DataFrame, key: str, text_col: str, terms: DataFrame) -> DataFrame:
    """df with n_tokens, n_known_tokens (tokens that are features of their own, each time they occur) and known_share. What it
    costs a row goes by the row's tokens, whatever the number of terms."""

    def run(own: features.Met) -> Mapping[str, pa.Array]:
        known = np.bincount(own.order[0], minlength=len(own.keys))
        there = np.flatnonzero(known)
        return {key: own.keys.take(pa.array(there)), "n_known_tokens": pa.array(known[there], pa.int32())}

    single = terms.select("feature").where(~F.col("feature").contains(" "))
    hits = features.met(df.where(F.col(key).isNotNull()), key, text_col, Features("count"), single, run, f"`{key}` {dict(df.dtypes)[key]}, n_known_tokens int")
    out = df.withColumn("n_tokens", F.size(N.tokenize(F.col(text_col)))).join(hits, key, "left").withColumn("n_known_tokens", F.coalesce("n_known_tokens", F.lit(0)))
    return out.withColumn("known_share", share(F.col("n_known_tokens"), F.col("n_tokens")))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


@dataclass
class TableModel:
    """One classifier a level over the terms of a text; levels' classes come one after another in the blocks.

    bayes: multinomial naive Bayes with counts of one added, whose weights are log(1 + count), and a class's low is what
    each known term adds besides. cosine: the softmax of the cosine to each class's mean over a temperature."""

    tree: Tree
    weights: DataFrame  # feature, block, w
    kind: str
    prior: list[float]
    low: list[float]
    how: Features
    n_terms: int
    temperature: float = 1.0

    def sums(self, df: DataFrame, key: str, text_col: str) -> DataFrame:
        """key, _s (the weights' sum by class), _known (known terms), _words (single ones among them), _square. Texts without
        known terms have no row."""
        n, wide = len(self.prior), min(BLOCK, len(self.prior))

        def run(own: features.Met) -> Mapping[str, pa.Array]:
            many = len(own.keys)
            block = own.table.column("block").to_numpy()
            w = features.whole(own.table.column("w"))
            known = np.zeros(len(own.names))
            known[own.at] = 1
            single = pc.invert(pc.match_substring(own.names, " ")).to_numpy(zero_copy_only=False)
            tf = own.tf * known[own.term]
            out = np.zeros((many, n if n <= BLOCK else -(-n // BLOCK) * BLOCK))
            for b in np.unique(block[block != KNOWN]):
                of = np.flatnonzero(block == b)
                place = np.full(len(own.names), -1)
                place[own.at[of]] = np.arange(len(of))
                weights = w.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), wide)
                hit = np.flatnonzero(place[own.term] >= 0)
                for a in range(0, len(hit), features.PAIRS):  # some pairs at a time: a term's weights are a row of numbers
                    part = hit[a : a + features.PAIRS]
                    row = own.row[part]
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    out[row[first], b * BLOCK : b * BLOCK + wide] += np.add.reduceat(weights[place[own.term[part]]] * own.tf[part][:, None], first)
            there = np.flatnonzero(np.bincount(own.row, tf, many))
            numbers = {"_known": tf, "_words": tf * single[own.term], "_square": tf * tf}
            flat = pa.array(out[there, :n].ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * n, pa.int32()), flat)
            return {key: own.keys.take(pa.array(there)), "_s": lists, **{c: pa.array(np.bincount(own.row, x, many)[there], pa.float64()) for c, x in numbers.items()}}

        weights = self.weights.where("block >= 0 or w is not null")  # a row a term and block, not two
        return features.met(df.where(F.col(key).isNotNull()), key, text_col, self.how, weights, run, f"`{key}` {dict(df.dtypes)[key]}, _s array<double>, _known double, _words double, _square double", small=bool(self.how.most) and self.how.most * n <= NUMBERS)

    def probabilities(self, df: DataFrame, key: str, text_col: str, sums: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
        """df with an array column p_<level> a level, n_tokens, n_known_tokens and known_share. sums: those of the texts, if
        they are there already."""
        zero = F.lit(0.0)
        n = len(self.prior)
        sums = self.sums(df, key, text_col) if sums is None else sums
        counted = df.withColumn("n_tokens", F.size(N.tokenize(F.col(text_col))))  # before the join, which then need not move the text for it
        out = counted.join(sums, key, "left").withColumns({"_s": F.coalesce("_s", F.array_repeat(zero, n)), **{c: F.coalesce(c, zero) for c in ("_known", "_words", "_square")}})
        names, start = [], 1
        for level, size in zip(self.tree.levels, self.tree.sizes, strict=True):
            own = F.struct(F.slice("_s", start, size).alias("s"), "_known", F.sqrt("_square").alias("norm"))
            prior, low = (F.lit(x[start - 1 : start - 1 + size]) for x in (self.prior, self.low))
            out = out.withColumn(f"p_{level}", A.softmax(A.bind(own, self._margins(prior, low)), self.temperature))
            names.append(f"p_{level}")
            start += size
        out = out.withColumn("n_known_tokens", F.col("_words").cast("int"))
        return out.withColumn("known_share", share(F.col("n_known_tokens"), F.col("n_tokens"))).drop("_s", "_known", "_words", "_square"), names

    def _margins(self, prior: Column, low: Column):
        if self.kind == "bayes":
            return lambda v: F.zip_with(v["s"], F.zip_with(prior, low, lambda p, q: p + q * v["_known"]), lambda s, b: s + b)
        return lambda v: F.transform(v["s"], lambda s: F.when(v["norm"] > 0, s / v["norm"]).otherwise(0.0))


def class_counts(df: DataFrame, key: str, text_col: str, labels: Sequence[str], how: Features) -> DataFrame:
    """feature, cells: a term's occurrences (total) and rows (df) by the rows' labels. Summed in the tasks before they move; a
    term's cells are one row, so that what is learned from them, or from some of them, is worked out where they lie."""
    counts = features.term_counts(df.select(key, *labels, text_col), key, text_col, how, labels)
    counts = counts.groupBy("feature", *labels).agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    return counts.groupBy("feature").agg(F.collect_list(F.struct(*labels, "total", "df")).alias("cells"))


def _by_class(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, class and occurrences, summed, of rows feature, classes, totals; a total belongs to one class a level, -1 is none."""
    classes, totals = batch.column("classes"), batch.column("totals")
    cells = totals.value_lengths().to_numpy(zero_copy_only=False)
    label, total = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (classes, totals))
    levels = len(label) // max(len(total), 1)
    row, total = (np.repeat(x, levels) for x in (np.repeat(np.arange(len(cells)), cells), total))
    known = label >= 0
    many = int(label.max(initial=0)) + 1
    pairs, place = np.unique(row[known] * many + label[known], return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, place, total[known])
    return pairs // many, pairs % many, n


def fit_table(df: DataFrame, key: str, text_col: str, tree: Tree, how: Features, kind: str = "bayes", temperature: float | None = None, counted: DataFrame | None = None) -> TableModel:
    """Counts by term and classes, from one pass over the texts and summed before they move; the driver gets a few numbers a class. Rows whose labels the
    tree lacks help to choose the terms, and no class. counted: these rows' `class_counts` by the tree's levels, if they are there already."""
    codes = [f"code_{c}" for c in tree.levels]
    coded = tree.encode(df).select(key, *codes, text_col)
    starts = [sum(tree.sizes[:k]) for k in range(len(tree.levels))]
    if counted is None:
        counts = stored(class_counts(coded, key, text_col, codes, how), "counts")
        found = lambda x: [x[c] for c in codes]
    else:
        counts = counted
        found = lambda x: [tree.code(x[c], k) for k, c in enumerate(tree.levels)]
    classes = F.flatten(F.transform("cells", lambda x: F.array(*[F.when(c >= 0, c + s).otherwise(-1) for c, s in zip(found(x), starts, strict=True)])))
    add = lambda c: F.aggregate(F.transform("cells", lambda x: x[c]), F.lit(0).cast("long"), lambda a, x: a + x).alias(c)
    terms = counts.select("feature", add("df"), add("total"), classes.alias("classes"), F.transform("cells", lambda x: x["total"]).alias("totals")).where("df > 0")
    n_rows = df.count()
    if how.most:  # the choice moves names alone
        terms = terms.join(features.within(terms.select("feature", "df", "total"), n_rows, how).select("feature"), "feature", "left_semi")
    else:
        terms = features.within(terms, n_rows, how)
    terms = stored(terms.select("feature", "classes", "totals"), "terms")
    n = sum(tree.sizes)
    wide = min(BLOCK, n)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(n, np.int64), np.zeros(n)
        for batch in batches:
            _, label, times = _by_class(batch)
            np.add.at(total, label, times)
            np.add.at(square, label, times.astype(float) ** 2)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there]), pa.array(square[there])], ["class", "n", "square"])

    rows, total, square = [0] * n, [0] * n, [0.0] * n
    own = F.array(*[F.when(F.col(c) >= 0, F.col(c) + s) for c, s in zip(codes, starts, strict=True)])
    for r in coded.select(F.explode(own).alias("class")).where("class is not null").groupBy("class").count().collect():  # one row a class
        rows[r["class"]] = r["count"]
    for r in terms.mapInArrow(numbers, "class int, n long, square double").groupBy("class").agg(F.sum("n").alias("n"), F.sum("square").alias("square")).collect():  # one row a class
        total[r["class"]], square[r["class"]] = r.n, r.square
    n_terms = terms.count()
    norms = np.array([math.sqrt(x) or 1.0 for x in square])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("feature")
            row, label, times = _by_class(batch)
            others = pa.array(np.bincount(row, minlength=len(names)) > 0)
            empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(names) + 1), pa.int32()), pa.array([], pa.float64()), mask=others)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), KNOWN), pa.int32()), empty], ["feature", "block", "w"])
            weight = np.log1p(times) if kind == "bayes" else times / norms[label]
            many = n // BLOCK + 1
            blocks, place = np.unique(row * many + label // BLOCK, return_inverse=True)
            for a in range(0, len(blocks), ROWS):  # some rows at a time: each is a block of numbers
                part = blocks[a : a + ROWS]
                w, (first, last) = np.zeros((len(part), wide)), np.searchsorted(place, [a, a + ROWS])
                w[place[first:last] - a, label[first:last] % BLOCK] = weight[first:last]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * wide, pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(part // many)), pa.array(part % many, pa.int32()), lists], ["feature", "block", "w"])

    weights = stored(terms.mapInArrow(weigh, "feature string, block int, w array<double>"), "weights")
    prior, low = [0.0] * n, [0.0] * n
    if kind == "bayes":
        for s, size in zip(starts, tree.sizes, strict=True):
            every = sum(rows[s : s + size]) + size
            for k in range(s, s + size):
                prior[k], low[k] = math.log((rows[k] + 1) / every), -math.log(total[k] + n_terms) if total[k] + n_terms else 0.0
    return TableModel(tree, weights, kind, prior, low, how, n_terms, temperature or (1.0 if kind == "bayes" else 0.1))
