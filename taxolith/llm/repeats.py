"""Suffix-array dedup: difference-cover suffix sorting, one block of suffix buckets at a time.

Which `LENGTH`-byte strings start more than once is decided in three steps, none of which loses or invents a repeat.

1. Buckets. A string's bucket is its least hashed k-mer (leftmost of equals); equal strings have the same one, at the
   same offset. Consecutive starts with one k-mer occurrence form a run; runs are few (about two in `LENGTH` bytes).
   Runs whose whole stretch of text is equal settle each other by counts alone, which Spark sums in the tasks first.
2. Runs of one bucket whose stretches differ may share strings in part. Their texts are cut into slices of `STEP`
   starts, dealt by the hash of what all starts of a slice have in common, and only slices that meet another one stay.
3. A task concatenates slices up to `BLOCK` bytes, ranks the suffixes at difference-cover positions (by doubling, up
   to more than LENGTH bytes), sorts the starts' suffixes by their first `PERIOD` bytes, and resolves the ties bucket by
   bucket with the ranks at the offset where both suffixes are in the cover. Neighbours in that order are compared byte
   by byte. Memory is bounded by the block: a bucket that is larger than a block is refined before it is dealt, down to
   buckets of one string of LENGTH bytes, whose members need no order, only a count that tasks sum before it moves.

No step gathers the rows of one key in one task: a key's rows meet its count by `common.spread_join`.

Beside what is removed, `passage_words` tells how many of a document's words lie in passages of `PASSAGE` words (op6's
words) that another document has too; these may have fewer than LENGTH bytes. Runs of word windows are found in the same
way, and windows of runs that are not shared as a whole are counted one by one, by 64-bit hashes.

The results are a function of the text and its number of copies, so they are worked out once for each distinct text.

Defined cases: null and empty texts, and texts shorter than LENGTH, keep all bytes; copies of a text of LENGTH bytes or
more lose all of them; repeated rows are copies; overlapping repeats in one text count; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.decontamination import words
from taxolith.llm.near_duplicates import bitmap, maybe_in, one_value, value_bitmap

LENGTH = 400
MER = 24
STEP = 64
PERIOD = 64
BLOCK = 1 << 20
#: Words of a passage that is reported when another document has it too, and of the k-mers that its runs go by.
PASSAGE = 51
PASSAGE_MER = 12
ROOT = 8  # the square root of PERIOD
COVER = np.array(sorted({*range(ROOT), *(k % PERIOD for k in range(ROOT, PERIOD, ROOT))}))
IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: For two residues, the least offset that brings both into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if IN_COVER[(i + d) % PERIOD] and IN_COVER[(j + d) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)], np.int64)
RUNS = "text long, key long, ctx long, s int, e int, a int, k long, doc_id long, n_bytes long, sha binary"


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte on, as little-endian numbers; data must have 8 bytes to spare."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    table = full.reshape(rows, width)
    forward = np.minimum.accumulate(table, 1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH, mer: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, row, first start, last start and k-mer place of the runs of all rows (places in data)."""
    padded = np.concatenate([data, np.zeros(mer + 8, np.uint8)])
    word = words_at(padded)
    mers = common.mixed(word[: len(data)] * np.uint64(0x9E3779B97F4A7C15) + word[8 : len(data) + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + (word[16 : len(data) + 16]) * np.uint64(0x165667B19E3779F9))
    place = np.arange(len(data), dtype=np.uint64)
    least = sliding_least((mers & np.uint64(0xFFFFFFFF00000000)) | place, length - mer + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(at)
    fits = np.maximum(size - length + 1, 0)
    row = np.repeat(np.arange(len(size)), fits)
    start = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(fits) - fits), fits)
    own = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(row) != 0)])) if len(row) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(row)) - 1
    return mers[own[new]], row[new], start[new], start[last] if len(row) else new, own[new]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run, and a row (with k, doc_id, n_bytes, sha) for each text."""
    names = [x.split()[0] for x in RUNS.split(", ")]
    for batch in common.chunks(batches, "text"):
        data, at = common.raw(batch.column("text"))
        n = batch.num_rows
        spans = common.SpanHash(data)
        text = spans.of(at[:-1], at[1:]).view(np.int64)
        key, row, s, e, a = runs(data, at)
        ctx = common.mixed(spans.of(s, e + LENGTH) + (a - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        body = data.tobytes()
        cuts = at.tolist()
        sha = [hashlib.sha256(body[x:y]).digest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        base = at[row]
        no = pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(text[row]), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), *(pa.array((x - base).astype(np.int32)) for x in (s, e, a)), no, no, no, pa.nulls(len(row), pa.binary())], names)
        none, ints = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(text), none, none, ints, ints, ints, batch.column("k"), batch.column("doc_id"), pa.array(np.diff(at)), pa.array(sha, pa.binary())], names)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a text and its differing runs: slices of at most STEP starts, by the hash of what these have in common."""
    for batch in common.chunks(batches, "body"):
        out: list[tuple] = []
        for text, body, mine in zip(batch.column("text").to_pylist(), batch.column("body").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data = np.frombuffer(body.encode(), np.uint8)
            spans = common.SpanHash(data)
            if spans.of(np.array([0]), np.array([len(data)])).view(np.int64)[0] != text:
                continue  # another row of this key
            raw = data.tobytes()
            for r in mine:
                for j in range((r["a"] - r["e"]) // STEP, (r["a"] - r["s"]) // STEP + 1):
                    core = r["a"] - STEP * j
                    low, high = max(r["s"], core - STEP + 1), min(r["e"], core)
                    out.append((text, core, j, r["key"], low, high, raw[low : high + LENGTH], spans.of(np.array([core]), np.array([core - STEP + 1 + LENGTH]))[0]))
        if out:
            text, _, j, key, low, high, piece, code = zip(*out, strict=True)
            group = common.mixed(np.array(code, np.uint64) + np.array(key, np.int64).view(np.uint64) * np.uint64(31) + np.array(j, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(text, pa.int64()), pa.array(low, pa.int32()), pa.array(piece, pa.binary())], ["g", "text", "low", "piece"])


def dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Ranks from an order, and from where in it a value differs from the one before."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(data: np.ndarray, big: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes at cover positions, compared over at least `depth` bytes; -1 elsewhere.

    data has zeros after each piece, big its 8 bytes from each position on, end the end of each position's piece."""
    place = np.flatnonzero(IN_COVER[np.arange(len(end)) % PERIOD])
    keys = [big[place + k] for k in range(0, PERIOD, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(place), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    rank = dense(order, new)
    full, h = np.zeros(len(end), np.int64), PERIOD
    while h < depth and len(place) and rank.max() < len(place) - 1:
        full[place] = rank + 1
        there = place + h < end[place]
        later = np.where(there, full[np.where(there, place + h, 0)], 0)
        key = rank * (len(place) + 1) + later
        order = np.argsort(key, kind="stable")
        rank = dense(order, np.concatenate([[False], np.diff(key[order]) != 0]))
        h *= 2
    full[:] = -1
    full[place] = rank
    return full


def same(word: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether the `length` bytes at left and right are equal, eight at a time."""
    out = np.zeros(len(left), bool)
    on = np.arange(len(left))
    for k in [*range(0, length - 7, 8), length - 8]:
        on = on[word[left[on] + k] == word[right[on] + k]]
    out[on] = True
    return out


def repeated(pieces: list[bytes], starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the first starts[k] positions of each piece, whether their string is that of another one of these positions."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.cumsum(sizes + PERIOD) - sizes - PERIOD
    data = np.frombuffer(b"".join(p + b"\xff" * PERIOD for p in pieces) + b"\xff" * PERIOD, np.uint8) + np.uint8(1)  # UTF-8 has no 255: padding becomes 0
    end = np.repeat(first + sizes, sizes + PERIOD)
    p = np.repeat(first - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
    word = words_at(data)
    big = word.byteswap()
    rank = cover_ranks(data, big, end, length + PERIOD)
    q = p[np.lexsort([big[p + k] for k in range(PERIOD - 8, -1, -8)])]
    tie = np.zeros(len(q), bool)  # equal to the one before in the first PERIOD bytes
    tie[1:] = same(word, q[1:], q[:-1], PERIOD)
    bucket = np.cumsum(~tie)
    place = np.flatnonzero(tie | np.append(tie[1:], False))  # only these are left to sort
    group, mine = bucket[place], q[place]
    while len(mine):  # three-way partition around a pivot by the cover's ranks, all buckets at once
        edge = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
        count = np.diff(np.append(edge, len(group)))
        pivot = np.repeat(mine[edge + count // 2], count)
        d = SHIFT[mine % PERIOD, pivot % PERIOD]
        key = group * 3 + np.sign(rank[mine + d] - rank[pivot + d]) + 1
        order = np.argsort(key, kind="stable")
        key, mine = key[order], mine[order]
        q[place] = mine
        more = key % 3 != 1
        place, mine, group = place[more], mine[more], key[more]
    flags = np.zeros(len(data), bool)
    pair = np.flatnonzero(tie)
    pair = pair[same(word, q[pair], q[pair - 1], length)]
    flags[q[pair]] = True
    flags[q[pair - 1]] = True
    return flags[p]


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by group -> (text, s, e): stretches of repeated starts. A block ends only between groups."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        groups, text, low, pieces = zip(*rows, strict=True)
        starts = np.array([len(x) - LENGTH + 1 for x in pieces], np.int64)
        on = repeated(list(pieces), starts)
        owner = np.repeat(np.arange(len(rows)), starts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(np.array(low, np.int64), starts)
        edge = np.concatenate([[True], np.diff(owner) != 0, [True]])
        left = np.flatnonzero(on & (edge[:-1] | ~np.concatenate([[False], on[:-1]])))
        right = np.flatnonzero(on & (edge[1:] | ~np.concatenate([on[1:], [False]])))
        return pa.RecordBatch.from_arrays([pa.array(np.array(text, np.int64)[owner[left]]), pa.array(offset[left].astype(np.int32)), pa.array(offset[right].astype(np.int32))], ["text", "s", "e"])

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("g", "text", "low", "piece")), strict=True):
            if size >= BLOCK and row[0] != rows[-1][0]:
                yield block(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield block(rows)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of buckets that are larger than a block -> every string of theirs by two hashes."""
    for batch in common.chunks(batches, "piece"):
        data, at = common.raw(batch.column("piece"))
        starts = np.diff(at) - LENGTH + 1
        owner = np.repeat(np.arange(len(starts)), starts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
        p = at[owner] + offset
        one, two = (common.SpanHash(data, seed).of(p, p + LENGTH).view(np.int64) for seed in (1, 2))
        text, low = batch.column("text").to_numpy(), batch.column("low").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(text[owner]), pa.array((low[owner] + offset).astype(np.int32))], ["string", "check", "text", "s"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text and its stretches of repeated starts -> what is removed, and the spans and hash of the rest."""
    for batch in common.chunks(batches, "body"):
        rows = []
        for text, body, stretches in zip(*(batch.column(c).to_pylist() for c in ("text", "body", "stretches")), strict=True):
            raw = body.encode()
            data = np.frombuffer(raw, np.uint8)
            if common.SpanHash(data).of(np.array([0]), np.array([len(data)])).view(np.int64)[0] != text:
                continue
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, [x["s"] for x in stretches], 1)
            np.add.at(change, [x["e"] + LENGTH for x in stretches], -1)
            gone = np.cumsum(change[:-1]) > 0
            edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            spans = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)]
            rows.append((text, int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).digest()))
        if rows:
            text, removed, spans, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(sha, pa.binary())], ["text", "n_removed", "spans", "kept"])


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (text, k, ...) with `body`, read from the rows of docs whose key is k."""
    near = maybe_in(docs.select("k", F.col("text").alias("body")), "k", bitmap(wanted, "k"))
    return near.join(wanted, "k").drop("k")


def word_runs(data: np.ndarray, at: np.ndarray, length: int = PASSAGE, mer: int = PASSAGE_MER) -> tuple[np.ndarray, ...]:
    """As runs(), over words: key, ctx, row, first start, last start (numbers of words), the words' hash sums, and words by row."""
    _, _, row, code = words(data, at)
    n = len(code)
    count = np.bincount(row, minlength=len(at) - 1)
    base = np.concatenate([[0], np.cumsum(count)])
    spans = common.SpanHash.of_codes(code)
    mers = spans.of(np.arange(max(n - mer + 1, 0)), np.arange(max(n - mer + 1, 0)) + mer)
    place = np.arange(len(mers), dtype=np.uint64)
    anchor = (sliding_least((mers & np.uint64(0xFFFFFFFF00000000)) | place, length - mer + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.maximum(count - length + 1, 0)
    owner = np.repeat(np.arange(len(count)), fits)
    start = np.arange(len(owner)) + np.repeat(base[:-1] - (np.cumsum(fits) - fits), fits)
    own = anchor[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(own) != 0) | (np.diff(owner) != 0)])) if len(owner) else np.zeros(0, np.int64)
    last = start[np.append(new[1:], len(owner)) - 1] if len(owner) else new
    first, own = start[new], own[new]
    ctx = common.mixed(spans.of(first, last + length) + (own - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return mers[own].view(np.int64), ctx.view(np.int64), owner[new], first, last, spans, count


def slot_in(bits: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Whether the values' slot is set in a bitmap of near_duplicates.value_bitmap."""
    slot = (one_value(*values) & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def passage_words(docs: DataFrame, readers: DataFrame) -> DataFrame:
    """text, n, words: for every distinct text the number of its words, and how many of them lie in a passage of PASSAGE
    words that another, different text has too. Windows of one run that is shared as a whole count as one.

    docs has k and text, readers the row k that stands for each distinct text. The runs' hashes are counted first; two
    bitmaps of them let a second pass send on only what may be shared."""
    chosen = value_bitmap(readers, "text", "k")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Of every slice the texts that stand for themselves: their hashes, and their runs of word windows."""
        for batch in common.chunks(batches, "text"):
            data, at = common.raw(batch.column("text"))
            text = common.SpanHash(data).of(at[:-1], at[1:]).view(np.int64)
            own = slot_in(chosen, text, batch.column("k").to_numpy())
            if own.any():
                yield text[own], word_runs(*common.raw(batch.column("text").filter(pa.array(own))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text, key, ctx) of every run, and a row (text, n) for each text."""
        for text, (key, ctx, row, *_, count) in each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(text[row]), pa.array(key), pa.array(ctx), pa.nulls(len(row), pa.int64())], ["text", "key", "ctx", "n"])
            yield pa.RecordBatch.from_arrays([pa.array(text), *(pa.nulls(len(text), pa.int64()) for _ in "ab"), pa.array(count.astype(np.int64))], ["text", "key", "ctx", "n"])

    docs = docs.select("k", "text")
    runs_ = common.written(common.mapped(docs, first, "text long, key long, ctx long, n long"), "passages")
    rows = runs_.where("key is not null")
    shared = rows.groupBy("ctx").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("ctx")
    mixed = rows.groupBy("key").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b").select("key")
    whole, parts = value_bitmap(shared, "ctx"), value_bitmap(mixed, "key")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, (key, ctx, row, start, last, spans, count) in each(batches):
            base = (np.cumsum(count) - count)[row]
            split = slot_in(parts, key)
            one = np.flatnonzero(~split & slot_in(whole, ctx))
            yield pa.RecordBatch.from_arrays([pa.array(ctx[one]), pa.array(text[row[one]]), *(pa.array(x[one].astype(np.int32)) for x in (start - base, last - base))], ["h", "text", "s", "e"])
            many = np.flatnonzero(split)
            size = last[many] - start[many] + 1
            owner = np.repeat(many, size)
            at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            h = spans.of(at, at + PASSAGE).view(np.int64)
            place = pa.array((at - base[owner]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(text[row[owner]]), place, place], ["h", "text", "s", "e"])

    found = common.written(common.mapped(docs, second, "h long, text long, s int, e int"), "windows")
    again = common.written(found.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("h"), "again")
    hit = maybe_in(found, "h", bitmap(again, "h")).join(again, "h")  # of two written tables: Spark's skew join splits a hot window's rows
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", "e"))), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + x["e"] + PASSAGE - F.least(x["e"] + PASSAGE, F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"] + PASSAGE).alias("to")), lambda a: a["n"],
    )
    hit = hit.groupBy("text").agg(covered.cast("long").alias("words"))
    sizes = runs_.where("n is not null").select("text", "n").distinct()
    return sizes.join(hit, "text", "left").select("text", "n", F.coalesce("words", F.lit(0).cast("long")).alias("words"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (byte ranges), kept (SHA-256 of the rest), passage_words of every row."""
    docs = common.documents(docs, id_col, text_col)
    docs = docs.withColumn("k", F.coalesce("doc_id", F.xxhash64("text")))
    found = common.written(common.mapped(docs, _runs, RUNS), "runs")
    rows = found.where("key is not null").select("text", "key", "ctx", "s", "e", "a")
    texts = common.written(found.where("key is null").select("text", "k", "doc_id", "n_bytes", "sha"), "texts")
    reader = texts.groupBy("text").agg(F.min("k").alias("k"))

    # a stretch's hash, ctx, is over its text and the place of its k-mer, and so stands for the key too
    stretches = rows.groupBy("ctx").agg(F.count("*").alias("n"), F.min(F.struct("text", "key", "s", "e", "a")).alias("r"))
    stretches = common.written(stretches.select("ctx", "n", "r.*"), "stretches")
    copied = stretches.where("n > 1").select("ctx", "n")
    settled = maybe_in(rows.select("text", "ctx", "s", "e"), "ctx", bitmap(copied, "ctx"))
    settled = common.written(common.spread_join(settled, copied, "ctx", "text").where("n > 1").select("text", "s", "e").distinct(), "settled")
    common.discard(found)

    mixed = stretches.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    open_ = common.spread_join(maybe_in(stretches.drop("n"), "key", bitmap(mixed, "key")), mixed, "key", "ctx").where("m > 1")
    open_ = open_.groupBy("text").agg(F.collect_list(F.struct("key", "s", "e", "a")).alias("runs"))
    pieces = common.mapped(fetched(docs, open_.join(reader, "text")).select("text", "body", "runs"), _slices, "g long, text long, low int, piece binary")
    pieces = common.written(pieces, "slices")
    common.discard(stretches)
    groups = common.written(pieces.groupBy("g").agg(F.count("*").alias("m"), F.sum(F.octet_length("piece")).alias("size")).where("m > 1").select("g", "size"), "groups")
    small, large = groups.where(F.col("size") <= BLOCK), groups.where(F.col("size") > BLOCK)
    fitting = maybe_in(pieces, "g", bitmap(small, "g")).join(small, "g").select("g", "text", "low", "piece").repartition("g").sortWithinPartitions("g")
    partly = common.mapped(fitting, _flagged, "text long, s int, e int")
    refined = common.spread_join(maybe_in(pieces, "g", bitmap(large, "g")), large, "g", "text").where("size is not null")
    strings = common.mapped(refined.select("text", "low", "piece"), _strings, "string long, check long, text long, s int")
    strings = common.written(strings, "strings")
    often = strings.groupBy("string", "check").agg(F.count("*").alias("n")).where("n > 1").groupBy("string").agg(F.collect_list("check").alias("checks"))
    single = common.spread_join(strings, often, "string", "text").where(F.array_contains("checks", F.col("check"))).select("text", "s", F.col("s").alias("e"))

    every = settled.unionByName(partly).unionByName(single).groupBy("text").agg(F.collect_set(F.struct("s", "e")).alias("stretches"))
    every = common.written(every.join(reader, "text"), "removed")
    common.discard(settled, strings, groups, pieces)
    kept = common.mapped(fetched(docs, every).select("text", "body", "stretches"), _kept, "text long, n_removed long, spans array<struct<start:long,end:long>>, kept binary").dropDuplicates(["text"])
    copies = texts.groupBy("text").agg(F.count("*").alias("copies"))
    kept = passage_words(docs, reader).join(copies, "text").join(kept, "text", "left")
    kept = common.written(kept.withColumn("words", F.when((F.col("copies") > 1) & (F.col("n") >= PASSAGE), F.col("n")).otherwise(F.col("words"))).drop("n", "copies"), "kept")
    common.discard(every)
    return common.spread_join(texts, kept, "text", "k").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"), F.coalesce("kept", "sha").alias("kept"), F.col("words").alias("passage_words"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256"), "passage_words")
