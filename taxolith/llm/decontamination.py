"""Benchmark decontamination: an FM-index for each shard of documents, searched backwards for every test phrase.

A shard is a few megabytes of whole texts within a map task. Its words become numbers; a word that no phrase has cuts
the run (no phrase crosses it), and runs shorter than the shortest phrase are left out: neither loses an occurrence.
What remains gets a suffix order, its Burrows-Wheeler transform and a wavelet matrix of it. All phrases are searched
backwards at once through the matrix's ranks, their occurrences located by sampled suffix positions, and overlapping
occurrences merged into removal spans. Nothing is shuffled. The phrases reach the tasks in blocks of about
`BLOCK_WORDS` words of the benchmark, of which each begins one phrase at most, one map pass a block.

A phrase is a window of `WINDOW` consecutive words of an item, or a shorter item as a whole. Words are compared by
64-bit hashes of their bytes.

Defined cases: null and empty texts have no words and no spans; a null item key is left out, items without words have
no phrase; repeated items or documents each get their own result; an empty benchmark marks nothing; other columns are
ignored, or kept by `cleaned`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.toxicity import LOWER

WINDOW = 10
SAMPLED = 8
SHARD_BYTES = 1 << 20
#: Words of the benchmark, and so phrases, in one pass: some 60 bytes each on the driver and in a task.
BLOCK_WORDS = 1 << 20
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word of the rows."""
    on = IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(on & (first[:-1] | ~np.concatenate([[False], on[:-1]])))
    ends = np.flatnonzero(on & (first[1:] | ~np.concatenate([on[1:], [False]]))) + 1
    row = np.searchsorted(at, starts, "right") - 1
    return starts, ends, row, common.SpanHash(LOWER[data]).of(starts, ends)


class Phrases:
    """The distinct phrases of some items as arrays, by length, and the items that have each."""

    def __init__(self, ids: list[str], texts: list[str], window: int = WINDOW):
        data, at = common.raw(pa.array(texts, pa.string()))
        _, _, row, code = words(data, at)
        self.vocabulary = np.unique(code)
        number = (np.searchsorted(self.vocabulary, code) + 2).astype(np.int32)
        count = np.bincount(row, minlength=len(texts))
        first = np.cumsum(count) - count
        self.ids = ids
        self.groups = []
        for n in np.unique(np.minimum(count[count > 0], window)).tolist():
            own = np.flatnonzero((count == n) | (count > n) & (n == window))
            many = count[own] - n + 1
            item = np.repeat(own, many)
            start = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            chosen, which = np.unique(np.lib.stride_tricks.sliding_window_view(number, n)[start], axis=0, return_inverse=True)
            pairs = np.unique(which.ravel() * len(texts) + item)
            self.groups.append((n, chosen, (pairs % len(texts)).astype(np.int32), np.searchsorted(pairs // len(texts), np.arange(len(chosen) + 1))))
        self.shortest = self.groups[0][0] if self.groups else 0


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by doubling the compared length until all differ."""
    n, k = len(text), 1
    order = np.argsort(text, kind="stable")
    step = np.concatenate([[0], (np.diff(text[order]) != 0).astype(np.int64)])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(step)
    while rank[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        k *= 2
    return order


class FMIndex:
    """Symbols from 1; a 0 is put at the end."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])  # symbol -> its first row
        marked = order % SAMPLED == 0
        self.marked, self.sampled = marked, order[marked]
        self.before = np.cumsum(marked) - marked
        self.levels = []  # wavelet matrix: zeros before each place, by bit from the highest
        self.bits = max(1, int(text.max()).bit_length())
        row = self.bwt
        for bit in reversed(range(self.bits)):
            one = (row >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)]).astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            row = np.concatenate([row[one == 0], row[one == 1]])

    def step(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Row of the suffix that the symbol begins, for the rows before place: first row + rank in the transform."""
        low, high = np.zeros_like(place), place
        for bit, zeros, count in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            z0, z1 = zeros[low], zeros[high]
            low = np.where(one, count + low - z0, z0)
            high = np.where(one, count + high - z1, z1)
        return self.first[symbol] + high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases that occur, each with one of its places, for every occurrence."""
        number = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            symbol = phrases[number, j].astype(np.int64)
            there = symbol < len(self.first) - 1
            number, symbol, low, high = number[there], symbol[there], low[there], high[there]
            low, high = self.step(symbol, low), self.step(symbol, high)
            on = low < high
            number, low, high = number[on], low[on], high[on]
            if not len(number):
                return number, number
        count = high - low
        which = np.repeat(number, count)
        row = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        return which, self.locate(row)

    def locate(self, row: np.ndarray) -> np.ndarray:
        place, open_, steps = np.zeros(len(row), np.int64), np.arange(len(row)), 0
        while len(open_):
            found = self.marked[row]
            place[open_[found]] = self.sampled[self.before[row[found]]] + steps
            open_, row = open_[~found], row[~found]
            row = self.step(self.bwt[row], row)
            steps += 1
        return place


def shard(data: np.ndarray, at: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: words by row; row, start and end of removal spans with their number of words; (row, item) pairs."""
    starts, ends, row, code = words(data, at)
    n_words = np.bincount(row, minlength=len(at) - 1)
    none = np.zeros(0, np.int64)
    empty = n_words, none, none, none, none, np.zeros((0, 2), np.int64)
    if not phrases.groups or not len(code):
        return empty
    place = np.searchsorted(phrases.vocabulary, code)
    place[place == len(phrases.vocabulary)] = 0
    known = phrases.vocabulary[place] == code
    new = np.concatenate([[True], ~known[:-1] | (np.diff(row) != 0)])  # a run begins with a known word after one of these
    begin = np.flatnonzero(known & new)
    stop = np.flatnonzero(known & np.concatenate([new[1:] | ~known[1:], [True]])) + 1
    long = stop - begin >= phrases.shortest
    begin, size = begin[long], (stop - begin)[long]
    if not len(begin):
        return empty
    put = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.arange(put[-1]) - np.repeat(put[:-1] - begin, size + 1)
    text = np.ones(put[-1], np.int64)
    inside = np.ones(put[-1], bool)
    inside[put[1:] - 1] = False
    text[inside] = place[source[inside]] + 2
    index = FMIndex(text)
    change = np.zeros(len(code) + 1, np.int64)
    pairs = []
    for n, group, owners, owned in phrases.groups:
        which, where = index.search(group)
        if not len(which):
            continue
        word = source[where]
        np.add.at(change, word, 1)
        np.add.at(change, word + n, -1)
        count = owned[which + 1] - owned[which]
        item = owners[np.arange(count.sum()) + np.repeat(owned[which] - np.cumsum(count) + count, count)]
        pairs.append(np.unique(np.stack([np.repeat(row[word], count), item], 1), axis=0))
    hit = np.cumsum(change[:-1]) > 0
    if not hit.any():
        return empty
    edge = np.concatenate([[True], np.diff(row) != 0, [True]])
    left = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    right = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
    return n_words, row[left], starts[left], ends[right], right - left + 1, np.unique(np.concatenate(pairs), axis=0)


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size; an item is one block at least."""
    items = bench.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    size = items.agg(F.sum(F.length(F.regexp_replace("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]*[\x00-\x2F\x3A-\x60\x7B-\x7F]", "-")) + 1)).first()[0] or 0  # ends of words
    count = max(1, math.ceil(size / BLOCK_WORDS))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).collect()
        yield Phrases([r.id for r in rows], [r.text for r in rows])


def with_hits(docs: DataFrame, bench: DataFrame, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema=None) -> DataFrame:
    """docs with n_words, n_hit, items and spans (byte ranges of its UTF-8 text); own columns of these names give way.
    then: what to do with each marked batch in the same task, with the schema of its result."""
    common.tune(docs.sparkSession)
    names = ["n_words", "n_hit", "items", "spans"]
    found = blocks(bench)
    out, phrases, k = docs, next(found), 0
    while phrases is not None:
        later = next(found, None)
        kept = [c for c in out.columns if c not in names]

        def run(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases, kept: list[str] = kept, joined: bool = k > 0, then=then if later is None else None) -> Iterator[pa.RecordBatch]:
            for batch in common.chunks(batches, "text", SHARD_BYTES):
                marked = _marked(batch, phrases, kept, joined)
                yield then(marked) if then else marked

        own = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in kept), FOUND])
        out = common.mapped(out, run, schema if then and later is None else own)
        if later is not None:
            out = common.written(out, "hits")  # one block of phrases in a task at a time
        phrases, k = later, k + 1
    return out


def _marked(batch: pa.RecordBatch, phrases: Phrases, kept: list[str], joined: bool) -> pa.RecordBatch:
    """The kept columns of one shard, and what the phrases hit in it, joined to what earlier blocks found."""
    n_words, row, start, end, n, pairs = shard(*common.raw(batch.column("text")), phrases)
    base = common.raw(batch.column("text"))[1]
    count = batch.num_rows
    spans: list[list] = [[] for _ in range(count)]
    items: list[list] = [[] for _ in range(count)]
    hits = np.bincount(row, n, count).astype(np.int64).tolist()
    for r, a, b in zip(row.tolist(), (start - base[row]).tolist(), (end - base[row]).tolist(), strict=True):
        spans[r].append({"start": a, "end": b})
    for r, k in pairs.tolist():
        items[r].append(phrases.ids[k])
    if joined:
        hits = _joined(batch, n_words, spans, items)
    columns = [batch.column(c) for c in kept]
    new = [pa.array(n_words, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return pa.RecordBatch.from_arrays([*columns, *new], [*kept, "n_words", "n_hit", "items", "spans"])


def _joined(batch: pa.RecordBatch, n_words: np.ndarray, spans: list[list], items: list[list]) -> list[int]:
    """Add what earlier blocks found, in place; the new numbers of words hit."""
    hits = []
    for k, (text, old_spans, old_items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "items")), strict=True)):
        items[k] += old_items
        joined: list[dict] = []
        body = (text or "").encode()
        for s in sorted([*spans[k], *old_spans], key=lambda s: s["start"]):
            if joined and s["start"] <= joined[-1]["end"] or joined and not IS_WORD[np.frombuffer(body[joined[-1]["end"] : s["start"]], np.uint8)].any():
                joined[-1]["end"] = max(joined[-1]["end"], s["end"])
            else:
                joined.append(dict(s))
        spans[k] = joined
        hit = 0
        for s in joined:
            part = np.frombuffer(body[s["start"] : s["end"]], np.uint8)
            hit += len(words(part, np.array([0, len(part)]))[0])
        hits.append(hit)
    return hits


def cleaned(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without their benchmark passages: the removal spans are cut out of `text`, and n_chars follows it if it is
    there. A document of which no word is left goes; all others stay."""
    given = docs.schema
    aside = {c: f"_own_{c}" for c in docs.columns if c in ("n_words", "n_hit", "items", "spans")}
    docs = docs.withColumnsRenamed(aside)
    columns, schema = docs.columns, docs.schema

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        hit, total = (batch.column(c).to_numpy() for c in ("n_hit", "n_words"))
        batch = batch.filter(pa.array((hit == 0) | (hit < total)))
        texts = batch.column("text").to_pylist()
        for k, spans in enumerate(batch.column("spans").to_pylist()):
            if spans:
                body, at, parts = texts[k].encode(), 0, []
                for s in spans:
                    parts.append(body[at : s["start"]])
                    at = s["end"]
                texts[k] = b"".join([*parts, body[at:]]).decode()
        place = batch.schema.get_field_index("text")
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type)).select(columns)

    left = with_hits(docs, bench, cut, schema)
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns)
    return left.withColumnsRenamed({v: k for k, v in aside.items()}).select(given.names)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(common.documents(common.table(spark, sf_dir, "documents")), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
