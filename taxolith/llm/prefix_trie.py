"""Conversation prefix trie: union-find over the common prefixes of sorted neighbours, in descending depth.

A conversation is a key of one record a turn: the digest of role and text, and the length of the text. Keys are sorted by
range over the tasks. A task takes its distinct keys in blocks of about `BLOCK_BYTES`; in a block, the depth to which two
neighbours agree is an edge, and edges are united from the deepest on: where two components meet, a branching node is
made at that depth, or one side is that node already. Nodes with one child lie on the stretch from a node up to its
parent and are written out from it.

All nodes that hold neither the first nor the last key of a block are complete. The others, the prefixes of these two
keys, are what is left of the block: its contracted forest, one row with a few numbers a depth. Such rows are merged,
`FAN` neighbours at a time, by the same routine, until one is left, whose nodes are complete as well. A complete node
under one that is still open names it by the hash of its prefix, and gets its parent's key by a join on that.

The conversations that end at a node are hashed in order of their keys. They are sorted by ranges of (sequence, key), so
a sequence that many conversations share is dealt to many tasks: each joins its own run of keys to pieces of at most
`PIECE` keys, and one task feeds the pieces of a sequence, one after another, to SHA-256.

Defined cases: null roles and texts are empty; a null turn comes first, and equal turns are in the order of their digests,
then of their lengths; rows without a conv_id are left out; repeated rows are turns of their own; an empty table gives no
rows; other columns are ignored. A conversation's key (24 bytes a turn) has to fit in a row, whatever its texts hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

HEADS = 9
FAMILY = 5
RECORD = 24  # bytes of a turn in a key: 16 of a digest, 8 of the text's length
BLOCK_BYTES = 1 << 23
FAN = 64
PIECE = 1 << 16
NONE = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, node long, parent_node long"
SIDE = "n array<long>, low array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"
FOREST = "id long, first binary, last binary, " + ", ".join(f"{side}_{c}" for side in ("left", "right") for c in SIDE.split(", "))
BOTH = f"{NODES}, {FOREST}"
FIELDS = ("n", "low", "kids", "leaves", "saved", "ends")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key) of every conversation after its head has been taken from its family's first one. One shuffle by family."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    record = F.concat(digest, F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 16, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", record.alias("record")).withColumn("base", base)
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce("turn", F.lit(0)).alias("turn"), "record")
    own = rows.repartition("base").groupBy("base", "conv_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["record"]).alias("records"))
    heads = own.where("conv_id = base").select("base", F.col("records").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.join(heads, "base", "left").withColumn("h", h)
    new = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h")), F.slice("records", F.col("h") + 1, F.size("records")))
    return both.select("conv_id", F.unhex(F.array_join(new, "")).alias("key"))


def agree(a: bytes, b: bytes) -> int:
    """How many records two keys have in common from the start on."""
    n = min(len(a), len(b)) // RECORD
    x, y = (np.frombuffer(k, np.uint8, n * RECORD).reshape(-1, RECORD) for k in (a, b))
    off = np.flatnonzero((x != y).any(1))
    return int(off[0]) if len(off) else n


def lengths(key: bytes) -> np.ndarray:
    """The sum of the lengths of the first d texts, for d from 0."""
    own = np.frombuffer(key, np.uint8).reshape(-1, RECORD)[:, 16:].copy().view(">i8")[:, 0]
    return np.concatenate([[0], np.cumsum(own, dtype=np.int64)])


def prefix_names(key: bytes) -> list[int]:
    """A 64-bit name of each prefix, for 0 records and up."""
    h, out = hashlib.blake2b(digest_size=8), []
    for at in range(0, len(key) + RECORD, RECORD):
        out.append(int.from_bytes(h.copy().digest(), "little", signed=True))
        h.update(key[at : at + RECORD])
    return out


@dataclass
class Side:
    """What is known of the prefixes of one key, by depth: members that end there or in complete children, and so on."""

    n: list[int] = field(default_factory=list)
    low: list[int | None] = field(default_factory=list)
    kids: list[int] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    saved: list[int] = field(default_factory=list)
    ends: list[str | None] = field(default_factory=list)

    @staticmethod
    def bare(n: int) -> Side:
        return Side([0] * n, [None] * n, [0] * n, [0] * n, [0] * n, [None] * n)

    def put(self, k: int, values: tuple) -> None:
        for name, v in zip(FIELDS, values, strict=True):
            getattr(self, name)[k] = v

    def at(self, k: int) -> tuple:
        return tuple(getattr(self, name)[k] for name in FIELDS)


@dataclass
class Forest:
    """A block's prefixes of its first and its last key; those that both have are in `left`."""

    first: bytes
    last: bytes
    left: Side
    right: Side

    def row(self, k: int) -> tuple:
        return (k, self.first, self.last, *(getattr(s, name) for s in (self.left, self.right) for name in FIELDS))


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Items:
    """Trie nodes in sorted order, each with its depth, the key whose prefix it is, the depth to which it agrees with the
    one before it, and its values."""

    def __init__(self) -> None:
        self.depth: list[int] = []
        self.common: list[int] = []
        self.key: list[bytes] = []
        self.values: list[list] = [[] for _ in FIELDS]

    def add(self, depth: int, common_: int, key: bytes, values: tuple) -> int:
        self.depth.append(depth)
        self.common.append(common_)
        self.key.append(key)
        for own, v in zip(self.values, values, strict=True):
            own.append(v)
        return len(self.depth) - 1

    def join(self, k: int, values: tuple) -> None:
        """Add another part of the same node."""
        for own, v, name in zip(self.values, values, FIELDS, strict=True):
            own[k] = _least(own[k], v) if name == "low" else (own[k] or v) if name == "ends" else own[k] + v


def united(items: Items, first: int, last: int, final: bool, named: bool) -> tuple[list[tuple], Forest | None]:
    """The complete nodes of a block, and what is left of it. first, last: the items of its outer keys. named: nodes get
    the names of their prefixes, as others may ask for them."""
    m = len(items.depth)
    depth, key = list(items.depth), list(items.key)
    n, low, kids, leaves, saved, ends = (list(v) for v in items.values)
    parent: list[int] = [-1] * m
    group, top = list(range(m)), list(range(m))  # union-find over the items; a component's top node

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    same: dict[int, int] = {}
    common_ = np.array(items.common[1:], np.int64)
    for e in np.argsort(-common_, kind="stable").tolist():
        l, i, j = int(common_[e]), find(e), find(e + 1)  # noqa: E741
        a, b = top[i], top[j]
        if depth[a] == l and depth[b] == l:  # both are that node
            same[b] = a
            n[a], kids[a], leaves[a], saved[a] = n[a] + n[b], kids[a] + kids[b], leaves[a] + leaves[b], saved[a] + saved[b]
            low[a], ends[a] = _least(low[a], low[b]), ends[a] or ends[b]
            group[j] = i
            continue
        if depth[a] != l and depth[b] != l:  # they meet below their tops: a new branching node
            own = len(depth)
            for values, v in zip((depth, key, n, low, kids, leaves, saved, ends, parent), (l, key[a], 0, None, 0, 0, 0, None, -1), strict=True):
                values.append(v)
            parent[a] = parent[b] = own
        else:
            own, child = (a, b) if depth[a] == l else (b, a)
            parent[child] = own
        group[j] = i
        top[i] = own

    def up(k: int) -> int:
        p = parent[k]
        while p in same:
            p = same[p]
        return p

    live = [k for k in range(len(depth)) if k not in same]
    above = {k: up(k) for k in live}
    spines: list[list[int]] = []
    for k in (first, last):
        while k in same:
            k = same[k]
        chain = []
        while k >= 0:
            chain.append(k)
            k = above[k]
        spines.append(chain)
    is_open = set() if final else {*spines[0], *spines[1]}
    sums: dict[bytes, np.ndarray] = {}
    done: list[int] = []
    below: dict[int, int] = {}  # saved over the whole subtree, from a node's depth on
    for k in sorted(live, key=lambda k: -depth[k]):  # children come before their parents
        if k in is_open:
            continue
        done.append(k)
        if not kids[k]:
            leaves[k] = 1
        size = sums.get(key[k])
        if size is None:
            size = sums[key[k]] = lengths(key[k])
        own = n[k] - 1
        d, p = depth[k], above[k]
        below[k] = saved[k] + own * int(size[d] - size[d - 1] if d else 0)
        if p >= 0:
            n[p], low[p], kids[p], leaves[p] = n[p] + n[k], _least(low[p], low[k]), kids[p] + 1, leaves[p] + leaves[k]
            saved[p] += saved[k] + own * int(size[d] - size[depth[p]])
    names: dict[bytes, list[int]] = {}

    def name(k: int, d: int) -> int:
        if key[k] not in names:
            names[key[k]] = prefix_names(key[k])
        return names[key[k]][d]

    rows: list[tuple] = []
    for k in done:
        d, p, size = depth[k], above[k], sums[key[k]]
        start = depth[p] if p >= 0 else -1
        for e in range(start + 1, d + 1):
            whole = below[k] if e == d else saved[k] + (n[k] - 1) * int(size[d] - size[max(e - 1, 0)])
            over = (low[k], None) if e > start + 1 else (None, None) if p < 0 else (None, name(p, start)) if p in is_open else (low[p], None)
            rows.append((low[k], e, over[0], n[k], kids[k] if e == d else 1, leaves[k], whole, ends[k] if e == d else None, name(k, e) if named else None, over[1]))
    if final:
        return rows, None
    values = lambda k: (n[k], low[k], kids[k], leaves[k], saved[k], ends[k])
    one, two = items.key[first][: items.depth[first] * RECORD], items.key[last][: items.depth[last] * RECORD]
    shared = agree(one, two)
    left, right = Side.bare(len(one) // RECORD + 1), Side.bare(len(two) // RECORD - shared)
    for k in spines[0]:
        left.put(depth[k], values(k))
    for k in spines[1]:
        if depth[k] > shared:
            right.put(depth[k] - shared - 1, values(k))
    return rows, Forest(one, two, left, right)


def merged(forests: list[Forest], final: bool) -> tuple[list[tuple], Forest | None]:
    """Neighbouring forests as one: the prefixes that the next first key shares with the last one are the same nodes."""
    items, path, before, first = Items(), [], b"", 0
    for k, f in enumerate(forests):
        shared = agree(before, f.first) if k else -1
        for d in range(len(f.first) // RECORD + 1):
            if d <= shared:
                items.join(path[d], f.left.at(d))
            else:
                path[d:] = [items.add(d, max(d - 1, 0), f.first, f.left.at(d))]
        if not k:
            first = path[-1]
        split = agree(f.first, f.last)
        for d in range(split + 1, len(f.last) // RECORD + 1):
            path[d:] = [items.add(d, d - 1, f.last, f.right.at(d - split - 1))]
        path = path[: len(f.last) // RECORD + 1]
        before = f.last
    return united(items, first, path[-1], final, True)


def _nodes(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2
    for a in range(0, len(rows), 50_000):
        columns = list(zip(*rows[a : a + 50_000], strict=True))
        n = len(columns[0])
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *(pa.nulls(n, t) for t in _forest_kinds())], _names())


def _forest_kinds() -> list[pa.DataType]:
    side = [pa.list_(pa.int64())] * 5 + [pa.list_(pa.string())]
    return [pa.int64(), pa.binary(), pa.binary(), *side, *side]


def _names() -> list[str]:
    return [c.split(" ")[0] for c in BOTH.split(", ")]


def _left_over(k: int, forest: Forest) -> pa.RecordBatch:
    nothing = [pa.nulls(1, t) for t in [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2]
    return pa.RecordBatch.from_arrays([*nothing, *(pa.array([v], t) for v, t in zip(forest.row(k), _forest_kinds(), strict=True))], _names())


def _block(keys: list[bytes], n: list[int], low: list[int]) -> tuple[list[tuple], Forest | None]:
    """A block of distinct sorted keys. A key of one conversation has its end's hash at once, others name their key."""
    items = Items()
    for k, key in enumerate(keys):
        ends = hashlib.sha256(str(low[k]).encode()).hexdigest() if n[k] == 1 else "=" + hashlib.md5(key).hexdigest()
        items.add(len(key) // RECORD, agree(keys[k - 1], key) if k else 0, key, (n[k], low[k], 0, 0, 0, ends))
    return united(items, 0, len(keys) - 1, False, False)


def _local(block: int, fan: int):
    """Sorted distinct keys -> complete nodes, and one forest a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests: list[Forest] = []
        keys, n, low, size = [], [], [], 0
        for batch in batches:
            for key, count, least in zip(batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("low").to_pylist(), strict=True):
                keys.append(key)
                n.append(count)
                low.append(least)
                size += len(key) + RECORD
                if size >= block:
                    rows, left = _block(keys, n, low)
                    yield from _nodes(rows)
                    forests.append(left)
                    keys, n, low, size = [], [], [], 0
                    if len(forests) >= fan:
                        rows, left = merged(forests, False)
                        yield from _nodes(rows)
                        forests = [left]
        if keys:
            rows, left = _block(keys, n, low)
            yield from _nodes(rows)
            forests.append(left)
        if len(forests) > 1:
            rows, left = merged(forests, False)
            yield from _nodes(rows)
            forests = [left]
        if forests:
            yield _left_over(TaskContext.get().partitionId(), forests[0])

    return run


def _merging(final: bool, fan: int):
    def run(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: r["id"])
        forests = [Forest(r["first"], r["last"], *(Side(*(r[f"{side}_{c}"] for c in FIELDS)) for side in ("left", "right"))) for r in got]
        rows, left = merged(forests, final)
        out = list(_nodes(rows))
        return pa.Table.from_batches(out + ([_left_over(got[0]["id"] // fan, left)] if left else []))

    return run


def _ends(most: int):
    """(sequence, conv_id) in order -> hashes of the sequences that begin and end within the task, if several conversations
    have them, and pieces of its first and last ones and of long ones."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, run, in_pieces, rows = None, [], True, []

        def joined() -> bytes:
            return ",".join(map(str, run)).encode()

        def flushed() -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["seq", "sha", "place", "piece"])
                rows.clear()

        for batch in batches:
            for seq, conv in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if seq != current:
                    if in_pieces and run:
                        rows.append((current, None, run[0], joined()))
                    elif len(run) > 1:  # a single one is hashed where its node is made
                        rows.append((current, hashlib.sha256(joined()).hexdigest(), None, None))
                    current, run, in_pieces = seq, [], current is None
                run.append(conv)
                if len(run) == most:
                    rows.append((seq, None, run[0], joined()))
                    run, in_pieces = [], True
            yield from flushed()
        if run:
            rows.append((current, None, run[0], joined()))
            yield from flushed()

    return task


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by sequence and place -> the hash of each sequence."""
    current, h = None, None
    for batch in batches:
        done = []
        for seq, piece in zip(batch.column("seq").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if seq != current:
                if current is not None:
                    done.append((current, h.hexdigest()))
                current, h = seq, hashlib.sha256(piece)
            else:
                h.update(b"," + piece)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["seq", "sha"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([h.hexdigest()])], ["seq", "sha"])


def ends(convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(seq, sha) of every sequence that several conversations have; some others are in it too."""
    rows = convs.select(F.md5("key").alias("seq"), "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    found = common.written(common.mapped(rows, _ends(piece), "seq string, sha string, place long, piece binary"), "ends")
    parts = found.where("sha is null").select("seq", "place", "piece").repartition("seq").sortWithinPartitions("seq", "place")
    return found.where("sha is not null").select("seq", "sha").unionByName(common.mapped(parts.select("seq", "piece"), _in_order, "seq string, sha string"))


def trie(turns: DataFrame, block: int = BLOCK_BYTES, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """One row a node. block: bytes of keys at a time; fan: forests merged in a task; piece: keys of a sequence hashed at a time."""
    convs = common.written(rebuilt(turns), "convs")
    keys = convs.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).repartitionByRange("key").sortWithinPartitions("key")
    tables = [common.written(common.mapped(keys.select("key", "n", "low"), _local(block, fan), BOTH), "trie")]
    while True:
        left = tables[-1].where("id is not null")
        most = left.agg(F.max("id").alias("m")).first().m
        if most is None:
            break
        columns = [c.split(" ")[0] for c in FOREST.split(", ")]
        tables.append(common.written(left.select(*columns).groupBy(F.expr(f"id div {fan}").alias("_g")).applyInArrow(_merging(most < fan, fan), BOTH), "trie"))
    nodes = tables[0]
    for t in tables[1:]:
        nodes = nodes.unionByName(t)
    nodes = nodes.where("conv_id is not null").select(*[c.split(" ")[0] for c in NODES.split(", ")])
    known = nodes.where("node is not null").select(F.col("node").alias("parent_node"), F.col("conv_id").alias("found"))
    asking = common.spread_join(nodes.where("parent_node is not null"), known, "parent_node", "conv_id").withColumn("parent_conv_id", F.col("found")).drop("found")
    nodes = nodes.where("parent_node is null").unionByName(asking.select(*nodes.columns))
    shared = nodes.where(F.col("ends").startswith("=")).withColumn("seq", F.substring("ends", 2, 32)).join(ends(convs, piece), "seq", "left").withColumn("ends", F.col("sha"))
    nodes = nodes.where(F.col("ends").isNull() | ~F.col("ends").startswith("=")).unionByName(shared.select(*nodes.columns))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1] for x in string_split(conv_id::VARCHAR, '')])),
 lambda a, x: CASE WHEN xor(a, greatest(x, 0)) & 1 = 1 THEN xor(xor(a, greatest(x, 0)) >> 1, 3988292384) ELSE xor(a, greatest(x, 0)) >> 1 END), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM c)),
n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY 1),
r AS (SELECT i.conv_id, pos AS d, role, text FROM i JOIN c ON c.conv_id = i.base AND pos <= h UNION ALL SELECT i.conv_id, least(h, coalesce(n.n, 0)) + pos - h, role, text FROM i JOIN c ON c.conv_id = i.conv_id AND pos > h LEFT JOIN n ON n.conv_id = i.base),
p AS (SELECT conv_id, d, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS prefix, octet_length(encode(text)) AS size FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM i),
m AS (SELECT prefix, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(size) * (count(*) - 1) AS saved FROM p GROUP BY 1),
s AS (SELECT DISTINCT x.prefix AS a, y.prefix AS b, y.d - x.d AS gap FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.d >= x.d),
k AS (SELECT a, count(*) FILTER (gap = 1) AS kids FROM s GROUP BY 1),
t AS (SELECT a, count(*) FILTER (kids = 0) AS leaves, sum(m.saved) AS saved FROM s JOIN m ON m.prefix = s.b JOIN (SELECT a AS o, kids FROM k) ON o = s.b GROUP BY 1),
e AS (SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM p SEMI JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY 1) l ON p.conv_id = l.conv_id AND p.d = l.d GROUP BY 1)
SELECT m.conv_id::BIGINT AS conv_id, m.d::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, m.n::BIGINT AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM m JOIN k ON k.a = m.prefix JOIN t ON t.a = m.prefix LEFT JOIN e ON e.prefix = m.prefix LEFT JOIN (SELECT s.b, m.conv_id FROM s JOIN m ON m.prefix = s.a WHERE gap = 1) o ON o.b = m.prefix"""
