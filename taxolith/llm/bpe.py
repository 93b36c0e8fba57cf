"""Token counts: byte-pair merging on ragged numpy arrays, all sequences at once.

Texts are cut into pre-tokens that no merge can cross, on arrays of code points. Those of a batch that the worker has
not met yet (told apart by 64-bit hashes) are held as rows of symbols, cut where no merge can reach across, and
grouped by their present length; in each round every row applies its own lowest-rank pair wherever it occurs (from the
left, as one by one) and moves to a shorter group, until no pair of a row has a rank. What survives are its tokens. So a
row of any length takes about as many rounds as it has different merges, not as it has symbols. Vocabulary files are
read at a path parameter; nothing is trained.

Defined cases: null and empty texts have 0 tokens; repeated rows are counted row by row; strings that look like special
tokens are treated as the file's library treats them by default; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

NONE = np.iinfo(np.int32).max
#: Pre-tokens that a worker remembers at most.
CACHE = 1 << 20
SPACE = "▁"
#: Bytes of text at a time: new pre-tokens are merged together, so a slice is larger than elsewhere.
SLICE = 1 << 20
LIMIT = 4096


class Pairs:
    """(left symbol, right symbol) -> rank, merged symbol: an open-addressing table for whole arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], bridges: set[tuple[int, int]] | None = None):
        """bridges: first symbols that some merge brings together, as the end of its left and the start of its right part."""
        self.bridges = Pairs(dict.fromkeys(sorted(bridges), (0, 0))) if bridges else None
        n = max(len(pairs), 1)
        self.bits = int(4 * n - 1).bit_length()
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.rank = np.full(len(pairs) + 1, NONE, np.int32)
        self.merged = np.zeros(len(pairs) + 1, np.int32)
        mask = (1 << self.bits) - 1
        for k, ((a, b), (rank, merged)) in enumerate(pairs.items(), 1):
            key = a << 32 | b
            h = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.at[h]:
                h = (h + 1) & mask
            self.keys[h], self.at[h], self.rank[k], self.merged[k] = key, k, rank, merged

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The numbers of the pairs, 0 where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        shape, key = key.shape, key.ravel()
        h = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.at[h]
        open_ = np.flatnonzero((out > 0) & (self.keys[h] != key))
        h = h[open_]
        while len(open_):
            h = (h + 1) & ((1 << self.bits) - 1)
            out[open_] = got = self.at[h]
            more = (got > 0) & (self.keys[h] != key[open_])
            open_, h = open_[more], h[more]
        return out.reshape(shape)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge each row of a ragged array as far as it goes: the surviving symbols, and their number by row."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        new = np.ones(len(symbols), bool)  # a part begins where a row does, or where no merge can reach across
        if len(symbols):
            new[1:] = (owner[1:] != owner[:-1]) | (self.bridges.find(symbols[:-1], symbols[1:]) == 0 if self.bridges else False)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(symbols)))
        waiting: dict[int, list] = {}
        done: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[rows[0]])
            s = symbols[starts[rows][:, None] + np.arange(n)]
            waiting[n] = [(rows, s, self.find(s[:, :-1], s[:, 1:]))]
        while waiting:
            n = max(waiting)
            group = waiting.pop(n)
            rows, s, p = (np.concatenate([g[k] for g in group]) for k in range(3))
            rank = self.rank[p]
            low = rank.min(1, initial=NONE)
            on = low < NONE
            if not on.all():
                done.append((rows[~on], s[~on]))
                rows, s, p, rank, low = rows[on], s[on], p[on], rank[on], low[on]
            if len(rows):
                for rows, s, p in self._round(rows, s, p, rank == low[:, None], low):
                    waiting.setdefault(s.shape[1], []).append((rows, s, p))
        counts = np.zeros(len(starts), np.int64)
        for rows, s in done:
            counts[rows] = s.shape[1]
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(at[-1], np.int32)
        for rows, s in done:
            out[at[rows][:, None] + np.arange(s.shape[1])] = s
        return out, np.bincount(owner[starts], counts, len(lengths)).astype(np.int64)

    def _round(self, rows: np.ndarray, s: np.ndarray, p: np.ndarray, hit: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge every row's lowest-rank pair where it occurs, as merging from the left one by one would.

        Of overlapping occurrences the left ones are taken. After a merge that makes a pair of the same or a lower rank
        the rest of the row waits for the next round. Rows come back by their new lengths."""
        n = s.shape[1]
        if n > 2 and (hit[:, 1:] & hit[:, :-1]).any():
            place = np.arange(n - 1)
            begin = hit & ~np.concatenate([np.zeros((len(hit), 1), bool), hit[:, :-1]], 1)
            hit = hit & ((place - np.maximum.accumulate(np.where(begin, place, 0), 1)) % 2 == 0)
        r, j = np.nonzero(hit)
        merged = self.merged[p[r, j]]
        many = np.bincount(r, minlength=len(rows))
        if many.max() > 1:
            again = np.concatenate([[False], (r[1:] == r[:-1]) & (j[1:] == j[:-1] + 2)])
            before = np.where(again, np.concatenate([[0], merged[:-1]]), s[r, np.maximum(j - 1, 0)])
            left = np.where(j > 0, self.rank[self.find(before, merged)], NONE)
            right = np.where(j + 2 < n, self.rank[self.find(merged, s[r, np.minimum(j + 2, n - 1)])], NONE)
            stop = (np.minimum(left, right) <= low[r]).astype(np.int64)
            first = np.cumsum(many) - many
            passed = np.cumsum(stop) - stop
            keep = passed == passed[first][r]
            r, j, merged = r[keep], j[keep], merged[keep]
            many = np.bincount(r, minlength=len(rows))
        s = s.copy()
        s[r, j] = merged
        stay, pairs = np.ones(s.shape, bool), np.ones(p.shape, bool)
        stay[r, j + 1] = False
        pairs[r, j] = False
        number = np.arange(len(r)) - (np.cumsum(many) - many)[r]  # merges to the left in the row
        for k in np.flatnonzero(np.bincount(many)).tolist():
            own = many == k
            whole, size = own.all(), int(own.sum())
            t = (s[stay] if whole else s[own][stay[own]]).reshape(size, n - k)
            q = (p[pairs] if whole else p[own][pairs[own]]).reshape(size, n - 1 - k)
            mine = own[r]
            line = (np.cumsum(own) - 1)[r[mine]]
            place = j[mine] - number[mine]
            left, right = np.flatnonzero(place > 0), np.flatnonzero(place < n - 1 - k)
            q[line[left], place[left] - 1] = self.find(t[line[left], place[left] - 1], t[line[left], place[left]])
            q[line[right], place[right]] = self.find(t[line[right], place[right]], t[line[right], place[right] + 1])
            yield rows[own], t, q


class Known:
    """What a worker has learned of pre-tokens: number of tokens, and their ids, by hash; bounded by CACHE."""

    def __init__(self):
        self.bits = CACHE.bit_length()
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.zeros(1 << self.bits, np.int32)
        self.size, self.start, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        h = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.at[h]
        open_ = np.flatnonzero((out > 0) & (self.keys[h] != keys))
        h = h[open_]
        while len(open_):
            h = (h + 1) & ((1 << self.bits) - 1)
            out[open_] = got = self.at[h]
            more = (got > 0) & (self.keys[h] != keys[open_])
            open_, h = open_[more], h[more]
        return out

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray | None) -> None:
        number = np.arange(len(keys)) + len(self.size)
        h = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(keys):
            _, first = np.unique(h, return_index=True)
            first = first[self.at[h[first]] == 0]
            self.keys[h[first]], self.at[h[first]] = keys[first], number[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, number, h = keys[rest], number[rest], (h[rest] + 1) & ((1 << self.bits) - 1)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        if ids is not None:
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])


class Vocabulary:
    """Cuts texts into pre-tokens and merges those that are new to the worker."""

    codes: np.ndarray  # of code points, for hashes

    def __init__(self):
        self.known = Known()
        self.codes = np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        self.base = 0x5851F42D4C957F2D
        self.forth, self.back = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self.forth) < len(points) + 1:
            self.forth, self.back = (common.powers(b, len(points) * 5 // 4 + 1) for b in (self.base, pow(self.base, -1, 1 << 64)))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.codes[points] * self.forth[: len(points)], out=sums[1:])
        return common.mixed((sums[end] - sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def numbers(self, text: str, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers in `known` of the pre-tokens at start..end."""
        keys = self.hashes(points, start, end)
        out = self.known.find(keys)
        new = np.flatnonzero(out == 0)
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            if len(self.known.size) + len(fresh) > CACHE:
                self.known.clear()
                new = np.arange(len(keys))
                fresh, first = np.unique(keys, return_index=True)
            place = new[first]
            for k in range(0, len(place), CACHE // 2):  # a chunk's own pre-tokens always fit
                part = place[k : k + CACHE // 2]
                self.known.add(fresh[k : k + CACHE // 2], *self.learn([text[a:b] for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]))
            out[new] = self.known.find(keys[new])
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        raise NotImplementedError


def joined(texts: list[str], between: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts with `between` before each, as one string and as code points; where each text begins, and the end."""
    text = "".join([between + t for t in texts])
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return text, np.frombuffer(text.encode("utf-32-le"), np.uint32), starts


def sums_by_row(size: np.ndarray, start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of size over the words of each row, and the row bounds among the words."""
    cuts = np.searchsorted(start, rows)
    total = np.concatenate([[0], np.cumsum(size)])
    return np.diff(total[cuts]), cuts


class Pieces(Vocabulary):
    """A sentencepiece BPE model with byte fallback: a symbol outside the vocabulary counts its UTF-8 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = {model.id_to_piece(i): i for i in normal}
        scores = sorted({-model.get_score(i) for i in normal})
        place = {x: k for k, x in enumerate(scores)}
        inside = {c for p in pieces for c in p}
        symbol = pieces | {c: n + ord(c) for c in inside - pieces.keys()}
        self.first = n
        self.chars = np.arange(n, n + 0x110000, dtype=np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.chars[ord(c)] = k
        parts = [(p[:k], p[k:], place[-model.get_score(i)], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = Pairs({(symbol[a], symbol[b]): (rank, i) for a, b, rank, i in parts}, {(symbol[a[-1]], symbol[b[0]]) for a, b, *_ in parts})
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans words: this file needs another cut")
        self.alone = np.array([ord(c) for c in "\n\t\r" if c not in inside], np.uint32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, None]:
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        out, counts = self.pairs.merge(self.chars[code], np.fromiter(map(len, words), np.int64, len(words)))
        char = out.astype(np.int64) - self.first
        weight = 1 + (char >= 0x80).astype(np.int64) + (char >= 0x800) + (char >= 0x10000)
        sums = np.concatenate([[0], np.cumsum(weight)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts], None

    def counts(self, texts: list[str]) -> np.ndarray:
        text, points, rows = joined([t.replace(" ", SPACE) for t in texts], SPACE)
        space = points == ord(SPACE)
        alone = np.isin(points, self.alone)
        before = np.concatenate([[False], space[:-1]]), np.concatenate([[True], alone[:-1]])
        cut = (space & ~before[0]) | (alone != before[1])
        cut[rows[:-1]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(points))
        number = self.numbers(text, points, start, end)
        got, _ = sums_by_row(self.known.size[number], start, rows)
        return np.where(np.diff(rows) == 1, 0, got)  # an empty text has not even the leading space


class WordIds(Vocabulary):
    """A tokenizers BPE file with word ends (lower case, white space dropped)."""

    #: Code points from which texts go to the library whole: composition and case folding may differ there.
    TABLE = 0x180
    ODD = (0x130, 0x131, 0x149, 0x17F, *range(9), 11, 12, *range(14, 32), 127, *range(128, 161))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        end = spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte alphabet shows as themselves
        rest = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        self.pairs = Pairs(
            {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])},
            {(vocab[a[-1]], vocab[b[0] + end] if b == b[0] + end else vocab[b[0]]) for a, b in merges},
        )
        assert max(vocab.values()) < 1 << 16
        kinds = [regex.compile(x).match for x in (r"\s", r"\p{L}", r"\p{N}")]
        self.kind = np.array([next((k for k, m in enumerate(kinds) if m(chr(c))), 3) for c in range(self.TABLE)] + [0], np.uint8)
        self.odd = np.zeros(self.TABLE + 1, bool)
        self.odd[[*self.ODD, self.TABLE]] = True
        self.lower = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(self.TABLE)] + [32], np.uint32)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelt = [w.lower().encode() for w in words]
        data = np.frombuffer(b"".join(spelt), np.uint8)
        lengths = np.fromiter(map(len, spelt), np.int64, len(spelt))
        symbols = self.inner[data]
        last = np.cumsum(lengths) - 1
        symbols[last] = self.last[data[last]]
        out, counts = self.pairs.merge(symbols, lengths)
        return counts, out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and their number by text."""
        text, points, rows = joined(texts, " ")
        points = np.minimum(points, self.TABLE)
        odd = np.searchsorted(rows, np.flatnonzero(self.odd[points]), "right") - 1
        whole = sorted({*odd.tolist(), *(k for k, t in enumerate(texts) if any(x in t for x in self.special))})
        if whole:
            points = points.copy()
            for k in whole:
                points[rows[k] : rows[k + 1]] = 32
        low, kind = self.lower[points], self.kind[points]
        cut = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])
        quote = np.flatnonzero((low[:-2] == 39) & cut[:-2] & (kind[1:-1] == 1)) if len(low) > 2 else np.zeros(0, np.int64)
        if len(quote):  # 's 't 'm 'd 're 've 'll after another kind of character
            a, b = low[quote + 1], low[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = np.isin(a.astype(np.uint64) << np.uint64(32) | b, [ord(x[0]) << 32 | ord(x[1]) for x in ("re", "ve", "ll")])
            for at, n in ((quote[one], 2), (quote[two], 3)):
                cut[at + 1] = False
                then = at + n
                then = then[then < len(cut)]
                cut[then] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(points))
        keep = kind[start] != 0
        start, end = start[keep], end[keep]
        number = self.numbers(text, low, start, end)
        size, first = self.known.size[number], self.known.start[number]
        counts, cuts = sums_by_row(size, start, rows)
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.known.ids[np.arange(total[-1]) + np.repeat(first - total[:-1], size)]
        if whole:
            parts, at = [], 0
            for k in whole:
                stop = total[cuts[k]]
                own = np.array(self.library.encode(texts[k], add_special_tokens=False).ids, np.uint16)
                parts += [flat[at:stop], own]
                at, counts[k] = stop, len(own)
            flat = np.concatenate([*parts, flat[at:]])
        return flat, counts

    def counts(self, texts: list[str]) -> np.ndarray:
        return self.ids(texts)[1]


@lru_cache(maxsize=1)
def loaded(kind: Callable, path: str):
    """One per worker."""
    return kind(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, by the sentencepiece BPE model or tokenizers word BPE file at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(Pieces if path.endswith(".model") else WordIds, path)
        for batch in common.chunks(batches, "text", SLICE):
            counts = model.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(common.raw(batch.column("text"))[1])), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return common.mapped(common.documents(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
