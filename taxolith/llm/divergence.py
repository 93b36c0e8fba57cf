"""Source divergence audit: how far the word use of each source lies from other sources of its language, and by which terms.

Terms are runs of letters (ASCII letters, of which A-Z are lower-cased, and all other characters beyond ASCII); each
language keeps those in at least `LEAST_DOCS` of its documents. Texts are counted once, in the tasks: a slice sends one
row a (language, source, term), which Spark adds up.

The divergences of all pairs of sources are sums over all kept terms of a language, and are worked out in a cube: sources
are dealt into blocks of about `SOURCES` and terms into blocks of about `TERMS`, and a cell (block of sources, block of
sources, block of terms) gets the counts of its two slices, so a slice is sent to as many cells as there are blocks of
sources. A cell sends its partial sum for each of its pairs, and these are added up along the term axis. A term that no
source of a cell has adds the same amount for a pair, so it is not sent: the reduction adds that amount for all of them.

The arithmetic is exact: shares are whole numbers of 1e-9, worked out by long division in 64 bits or as decimals.

Defined cases: null text, language and source are empty strings; repeated rows are documents of their own; a source
without kept terms has counts of 0; a language without kept terms has divergences of 0; a source alone in its language
has no pairs; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxolith.llm import common

LEAST_DOCS = 3
UNIT = 1_000_000_000
MOST_TERMS = 200
SOURCES = 32
TERMS = 1024
SLICE_BYTES = 1 << 21
IS_LETTER = np.zeros(256, bool)
IS_LETTER[65:91] = IS_LETTER[97:123] = IS_LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every term of the rows; data is lower-cased."""
    on = IS_LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(on & (edge[:-1] | ~np.concatenate([[False], on[:-1]])))
    end = np.flatnonzero(on & (edge[1:] | ~np.concatenate([on[1:], [False]]))) + 1
    return start, end, np.searchsorted(at, start, "right") - 1, common.SpanHash(data).of(start, end)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of the bytes as a string column."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data[place]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> for each source and term of a slice, how often it occurs and in how many rows."""
    for batch in common.chunks(batches, "text", SLICE_BYTES):
        groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
        of_row = np.array([number[g] for g in groups])
        data, at = common.raw(batch.column("text"))
        data = LOWER[data]
        start, end, row, code = terms(data, at)
        if not len(start):
            continue
        group = of_row[row]
        order = np.lexsort((row, code, group))
        group, code, row = group[order], code[order], row[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (code[1:] != code[:-1])])
        place = np.flatnonzero(new)
        fresh = new.copy()
        fresh[1:] |= row[1:] != row[:-1]
        first, own = order[place], group[place]
        langs, sources = (pa.array([g[k] for g in number]).take(pa.array(own)) for k in (0, 1))
        counts = np.diff(np.append(place, len(order))), np.add.reduceat(fresh, place, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([langs, sources, strings(data, start[first], end[first]), *(pa.array(c.astype(np.int64)) for c in counts)], ["lang", "source", "term", "n", "docs"])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, total, new) of the kept terms: occurrences in the source and in the language; new marks one row a term."""
    common.tune(docs.sparkSession)
    found = common.mapped(docs, _counted, "lang string, source string, term string, n long, docs long")
    found = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # one row a source
    kept = found.select("lang", "source", "term", "n", F.sum("n").over(term).alias("total"), F.sum("docs").over(term).alias("df"), (F.row_number().over(term.orderBy("source")) == 1).alias("new"))
    return kept.where(F.col("df") >= LEAST_DOCS).drop("df")


def share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / total), exact."""
    return F.expr(f"1 + CAST({count} + 1 AS DECIMAL(20, 0)) * {UNIT}BD div CAST({total} AS DECIMAL(20, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays: two steps of a long division, whose values stay under 2 ** 63 up to counts of 9e13."""
    low, high = 10_000, UNIT // 10_000
    whole, rest = np.divmod((count + 1) * high, total)
    return 1 + whole * low + rest * low // total


def _cell(table: pa.Table) -> pa.Table:
    """Two slices -> source, item, the sum over the slices' terms, their number, what any other term adds, all terms."""
    source = table.column("source").combine_chunks().dictionary_encode()
    names, which = np.array(source.dictionary.to_pylist(), object), source.indices.to_numpy()
    block, n, total, size = (table.column(c).to_numpy() for c in ("own", "n", "total", "size"))
    there = table.column("code").is_valid().to_numpy()
    codes, place = np.unique(table.column("code").to_numpy()[there].astype(np.int64), return_inverse=True)
    count = np.zeros((len(names), len(codes)), np.int64)
    count[which[there], place] = n[there]
    of, all_ = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    of[which], all_[which] = block, np.maximum(total, 1)
    p, p_none = shares(count, all_[:, None]), shares(np.zeros_like(all_), all_)
    first, second = table.column("a")[0].as_py(), table.column("b")[0].as_py()
    rows: list[tuple] = []
    for i in range(len(names)):
        others = np.flatnonzero((np.arange(len(names)) != i) & ((of != of[i]) | (first == second)))
        if len(others):
            q, q_none = p[others], p_none[others]
            d, d_none = p[i] - q, p_none[i] - q_none
            rows.append((np.full(len(others), i), others, (d * d // q).sum(1), d_none * d_none // q_none))
    one, other, value, rest = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    lang = pa.array([table.column("lang")[0].as_py()] * len(one), pa.string())
    named = [pa.array(names[k].tolist(), pa.string()) for k in (one, other)]
    numbers = [pa.array(x.astype(np.int64)) for x in (value, np.full(len(one), len(codes)), rest, np.full(len(one), size[0]))]
    return pa.Table.from_arrays([lang, *named, *numbers], ["lang", "source", "item", "value", "seen", "rest", "size"])


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other one of its language."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("across"), F.greatest(F.lit(1), F.ceil(F.max("size") / TERMS)).alias("deep"))
    placed = groups.join(blocks, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("across")))
    columns = ("lang", "source", "own", "across", "total", "size")
    here = kept.select("lang", "source", "term", "n").join(placed, ["lang", "source"]).select(*columns, F.pmod(F.xxhash64("term"), F.col("deep")).alias("t"), F.xxhash64("term", F.lit(7)).alias("code"), "n")
    none = placed.select(*columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("deep") - 1)).alias("t"), F.lit(None).cast("long").alias("code"), F.lit(0).cast("long").alias("n"))  # a cell has all sources of its blocks, whatever their terms
    sent = here.unionByName(none).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))
    sent = sent.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "t", "source", "own", "total", "size", "code", "n")
    cells = sent.groupBy("lang", "a", "b", "t").applyInArrow(_cell, "lang string, source string, item string, value long, seen long, rest long, size long")
    sums = cells.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("rest").alias("rest"), F.max("size").alias("size"))
    return sums.select("lang", "source", "item", (F.col("value") + F.col("rest") * (F.col("size") - F.col("seen"))).alias("value"))


def audit(docs: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's other sources by divergence, and the terms that it uses more
    than its language does, the first `most` of them."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = common.written(counted(docs), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.count_if("new").alias("size"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(whole, "lang", "left")
    size = F.coalesce("size", F.lit(0).cast("long"))
    groups = common.written(groups.select("lang", "source", size.alias("size"), (F.coalesce("own", F.lit(0)) + size).alias("total"), (F.coalesce("in_lang", F.lit(0)) + size).alias("lang_total")), "groups")
    found = kept.select("lang", "source", "term", "n", F.col("total").alias("n_lang")).join(groups, ["lang", "source"])
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), share("n", "total").alias("p"), share("n_lang", "lang_total").alias("q")).where("p > q")
    own = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = found.select("lang", "source", "part", "item", gap("p", "q").alias("value")).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= most)
    others = pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return others.unionByName(top)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


ORACLE = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + v) AS p, 1 + 1000000000 * (k.n + 1) // (l.total + v) AS q
 FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 200"""
