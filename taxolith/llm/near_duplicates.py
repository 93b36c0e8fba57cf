"""MinHash near-dedup with BagMinHash: weighted-Jaccard signatures of the bags of five-word shingles.

A shingle with weight w (how often it occurs) owns the dyadic steps (0, 1], (1, 2], (2, 4] ... up to w. Each step has a
Poisson process in time whose rate is its width; every point falls on a random register and a random height, and
points above w are passed over (that is how a weight within a step takes its share). A register keeps its earliest
point, so two bags agree on a register with the probability of their weighted Jaccard similarity. Processes stop
once they are later than every register of their document, which keeps the work near the number of shingles.

Documents of one bag are one node. `BANDS` keys of `ROWS` registers each put nodes into buckets, whose pivot is the node
that comes first by a hash. Every node is held against the pivot that it meets most often, by the exact similarity of the
bags, and linked nodes get one class: as a pivot comes before its nodes, these links are a forest.
In buckets where a node is then not in its pivot's class, such nodes are compared with all members of other classes, in
blocks of `SIDE` by `SIDE` rows: pairs whose signatures agree on a share of `CLOSE` registers (nearly five standard
deviations below the threshold; the parameter `close` of `classes`, 0 for all pairs) get the exact test in their task, nearest ones first, unless they are in one class by
then. A block sends on only the links that join classes. So no class within a bucket is left apart, blocks bound the
memory, and neither copies nor documents around one passage make rows by the square of their number. Buckets are
counted by partial aggregation, so a group of copies is no hot task.

To fetch the bags of candidate nodes without moving all texts, a bitmap of hashed keys of bounded size goes to the
tasks as a first filter; the join behind it is exact.

Nodes are told apart by 64-bit hashes of their bags. Two bags at the threshold miss all bands with a probability of
about 6e-4.

Defined cases: null and empty texts, and texts without words, equal only texts of the same bytes; texts of fewer than
five words are one shingle; repeated rows share a class and each gets a row; a null key can only match equal bags;
an empty table gives no rows; other columns are ignored, or kept by `deduplicated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common
from taxolith.llm.decontamination import words
from taxolith.llm.graphs import components, tops

SHINGLE = 5
THRESHOLD = 0.8
REGISTERS = 256
BANDS = 40
ROWS = 8
MOST_BITS = 27
PAGE = 1 << 12
SIDE = 512
CLOSE = 0.68
SUBSETS = np.stack([np.random.default_rng(100 + k).choice(REGISTERS, ROWS, replace=False) for k in range(BANDS)])
FACTORS = np.random.default_rng(3).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle, repeats included, by row and hash."""
    n = len(at) - 1
    _, _, row, code = words(data, at)
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    size = np.maximum(count - SHINGLE + 1, 0)
    start = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    value = reduce(np.add, (code[start + k] * FACTORS[k] for k in range(SHINGLE))) if len(start) else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(n), size)
    extra_rows, extra = [], []
    for r in np.flatnonzero(size == 0).tolist():
        own = code[first[r] : first[r] + count[r]]
        extra_rows.append(r)
        extra.append(int((own * FACTORS[: len(own)]).sum(dtype=np.uint64)) if len(own) else int.from_bytes(hashlib.blake2b(data[at[r] : at[r + 1]].tobytes(), digest_size=8).digest(), "little"))
    rows = np.concatenate([rows, np.array(extra_rows, np.int64)])
    value = common.mixed(np.concatenate([value, np.array(extra, np.uint64)]))
    order = np.lexsort((value, rows))
    return rows[order], value[order]


def bags(rows: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and weight of the distinct shingles, and the hash of each row's bag."""
    new = np.concatenate([[True], (np.diff(rows) != 0) | (value[1:] != value[:-1])]) if len(rows) else np.zeros(0, bool)
    place = np.flatnonzero(new)
    weight = np.diff(np.append(place, len(rows)))
    row, shingle = rows[place], value[place]
    terms = common.mixed(shingle + weight.astype(np.uint64) * FACTORS[9])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
    cuts = np.searchsorted(row, np.arange(n + 1))
    return row, shingle, weight, common.mixed(total[cuts[1:]] - total[cuts[:-1]])


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n rows of m registers: the time of the earliest point."""
    out = np.full(n * m, np.inf)
    top = np.ceil(np.log2(weight)).astype(np.int64)  # number of the step that holds the weight
    steps = top + 1
    owner = np.repeat(np.arange(len(row)), steps)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = np.where(step == 0, 0, 2.0 ** (step - 1))
    width = np.where(step == 0, 1, 2.0 ** (step - 1))
    share = np.minimum((weight[owner] - low) / width, 1.0)
    key, row = common.mixed(shingle[owner] + step.astype(np.uint64) * FACTORS[10]), row[owner]
    time, drawn = np.zeros(len(key)), 0
    while len(key):
        many = 1 if len(key) > 20_000 else min(64, 16_000 // len(key) + 1)
        number = (np.arange(many, dtype=np.uint64) + np.uint64(drawn)) * FACTORS[11]
        drawn += many
        bits = common.mixed(key[:, None] + number)
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gap[:, 0] += time  # gaps are added one by one, so a time has the same bits however many points are drawn at once
        times = np.cumsum(gap, 1)
        more = common.mixed(bits ^ FACTORS[12])
        register = (more & np.uint64(m - 1)).astype(np.int64)
        below = (more >> np.uint64(11)).astype(np.float64) * 2.0**-53 < share[:, None]
        np.minimum.at(out, (row[:, None] * m + register)[below], times[below])
        time = times[:, -1]
        last = out.reshape(n, m).max(1)
        on = time < last[row]
        key, row, time, width, share = key[on], row[on], time[on], width[on], share[on]
    return out.reshape(n, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    bits = signature.view(np.uint64)
    return np.stack([common.mixed((bits[:, s] * FACTORS[: len(s)]).sum(1, dtype=np.uint64) + FACTORS[20] * np.uint64(k + 1)) for k, s in enumerate(SUBSETS)], 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "text"):
        n = batch.num_rows
        row, shingle, weight, bag = bags(*shingles(*common.raw(batch.column("text"))), n)
        signature = signatures(row, shingle, weight, n)
        short = (common.mixed(signature.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bag.view(np.int64)), *(pa.array([k.tobytes() for k in x], pa.binary()) for x in (band_keys(signature), short))], ["doc_id", "node", "bands", "short"])


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["band", "node"])


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of bounded size (2 ** MOST_BITS bits) in which the slot of every key of the column is set."""
    keys = common.written(keys.select(F.col(column).cast("long").alias("key")), "keys")  # counted first, then read
    bits = min(MOST_BITS, max(10, int(16 * keys.count()).bit_length()))
    out = _bits(keys.select(F.pmod(F.xxhash64("key"), F.lit(1 << bits)).alias("s")), bits)
    common.discard(keys)
    return out


def one_value(*values: np.ndarray) -> np.ndarray:
    """A mixed 64-bit value for each row of some columns of numbers."""
    out = np.zeros(len(values[0]), np.uint64)
    for v in values:
        out = common.mixed(out ^ v.view(np.uint64))
    return out


def value_bitmap(keys: DataFrame, *columns: str) -> np.ndarray:
    """The same with slots that tasks can work out for arrays of values (repeats.slot_in)."""
    keys = common.written(keys.select(*columns), "keys")
    bits = min(MOST_BITS, max(10, int(16 * keys.count()).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = one_value(*(c.to_numpy() for c in batch.columns)) & np.uint64((1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64))], ["s"])

    out = _bits(common.mapped(keys, slots, "s long"), bits)
    common.discard(keys)
    return out


def _bits(slots: DataFrame, bits: int) -> np.ndarray:
    """Tasks put the words together, so the driver gets them in blocks of PAGE words, a few hundred binary rows at most."""
    size = 1 << bits - 6
    page = min(PAGE, size)

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            word, value = batch.column("w").to_numpy(), batch.column("v").to_numpy().view(np.uint64)
            for k in np.unique(word // page).tolist():
                own = word // page == k
                found.setdefault(k, np.zeros(page, np.uint64))[word[own] % page] = value[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([x.tobytes() for x in found.values()], pa.binary())], ["page", "words"])

    words_ = slots.groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("v"))
    out = np.zeros(size, np.uint64)
    for r in common.mapped(words_.repartition(F.expr(f"w div {page}")), pages, "page long, words binary").collect():
        out[r.page * page : (r.page + 1) * page] = np.frombuffer(r.words, np.uint64)
    return out


def maybe_in(docs: DataFrame, column: str, bits: np.ndarray, there: bool = True) -> DataFrame:
    """Rows of docs whose key's slot is set (or is not): a first filter that loses no key of the bitmap."""
    n, columns = len(bits) * 64, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            on = (bits[s >> 6] >> (s & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.filter(pa.array(on == there)).select(columns)

    common.tune(docs.sparkSession)
    marked = docs.withColumn("_slot", F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(n)))
    return common.mapped(marked, run, docs.schema)


def elements(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The bags as sets: the second and later occurrences of a shingle are elements of their own (64 bits each)."""
    same = np.concatenate([[False], (np.diff(rows) == 0) & (value[1:] == value[:-1])]) if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows))
    again = place - np.maximum.accumulate(np.where(same, 0, place)) if len(rows) else place
    return common.mixed(value + again.astype(np.uint64) * FACTORS[13])


def _bag_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, "text"):
        n = batch.num_rows
        rows, value = shingles(*common.raw(batch.column("text")))
        *_, bag = bags(rows, value, n)
        same = bag.view(np.int64) == batch.column("node").to_numpy()
        cuts = np.searchsorted(rows, np.arange(n + 1))
        element = elements(rows, value)
        blobs = [np.sort(element[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bag.view(np.int64)), pa.array(blobs, pa.binary())], ["node", "bag"]).filter(pa.array(same))


def similar(x: bytes, y: bytes) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = np.sort(np.concatenate([a, b]))
    common_ = int((both[1:] == both[:-1]).sum())
    return common_ >= THRESHOLD * (len(both) - common_)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        on = [similar(x, y) for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))


def verified(pairs: DataFrame, blobs: DataFrame) -> DataFrame:
    """Links (a, b): the pairs (node, pivot) whose bags are similar enough. A pivot may be that of many nodes."""
    one = pairs.join(blobs.withColumnRenamed("bag", "bag_a"), "node")
    both = common.spread_join(one, blobs.select(F.col("node").alias("pivot"), F.col("bag").alias("bag_b")), "pivot", "node").where("bag_b is not null")
    return common.mapped(both.select(F.col("node").alias("a"), F.col("pivot").alias("b"), "bag_a", "bag_b"), _verify, "a long, b long")


def spanning(node: np.ndarray, root: np.ndarray, asks: np.ndarray, answers: np.ndarray, short: np.ndarray, bags_: list[bytes], close: float = CLOSE) -> list[tuple[int, int]]:
    """Links that join all classes of a block which some pair of an asking and an answering row links: the pairs whose
    signatures agree on a share of `close` are tested from the nearest on, and those whose classes are joined by then are
    passed over. With close = 0 all pairs are."""
    label = np.unique(root, return_inverse=True)[1]
    ask, answer = np.flatnonzero(asks), np.flatnonzero(answers)
    width = short.shape[1]
    level, left, right = [], [], []
    for k in ask.tolist():
        other = answer[label[answer] != label[k]]
        if len(other):
            score = (short[other] == short[k]).sum(1)
            other, score = other[score >= close * width], score[score >= close * width]
            level.append(score.astype(np.int16))
            right.append(other.astype(np.int32))
            left.append(np.full(len(other), k, np.int32))
    if not level:
        return []
    level, left, right = (np.concatenate(x) for x in (level, left, right))
    order = np.argsort(-level, kind="stable")
    left, right = left[order], right[order]
    out, step = [], 2048
    for at in range(0, len(left), step):
        a, b = left[at : at + step], right[at : at + step]
        on = label[a] != label[b]
        for i, j in zip(a[on].tolist(), b[on].tolist(), strict=True):
            if label[i] != label[j] and similar(bags_[i], bags_[j]):
                out.append((max(node[i], node[j]), min(node[i], node[j])))
                label[label == label[j]] = label[i]
    return out


def _near(close: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block -> links (a, b) within each block."""

    def block(rows: list[tuple]) -> pa.RecordBatch:
        _, nodes, roots, asks, answers, shorts, bags_ = zip(*rows, strict=True)
        table = np.frombuffer(b"".join(shorts), np.uint16).reshape(len(rows), -1)
        found = spanning(np.array(nodes, np.int64), np.array(roots, np.int64), np.array(asks), np.array(answers), table, list(bags_), close)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "root", "asks", "answers", "short", "bag")), strict=True):
                if rows and row[0] != rows[-1][0]:
                    yield block(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield block(rows)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", close: float = CLOSE) -> DataFrame:
    """(doc_id, node, root, class_id) for every row: its bag, the bag that stands for its class of near duplicates, and the
    least key of the class. close: the share of registers on which signatures of a bucket agree before bags are compared."""
    texts = common.documents(docs, id_col, text_col)
    signed = common.written(common.mapped(texts, _sign, "doc_id long, node long, bands binary, short binary"), "signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc"))
    first = signed.select("node", "bands", "short").dropDuplicates(["node"])
    rows = common.mapped(first.select("node", "bands"), _explode, "band long, node long")
    order = F.xxhash64("node")
    pivots = rows.groupBy("band").agg(F.min_by("node", order).alias("pivot"), F.count("*").alias("n")).where("n > 1").select("band", "pivot")
    buckets = common.written(rows.join(pivots, "band"), "buckets")

    pairs = buckets.where("node <> pivot").groupBy("node", "pivot").count()
    pairs = pairs.groupBy("node").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot"))  # the pivot met most often first
    pairs = common.written(pairs, "pairs")
    candidates = common.written(buckets.select("node").distinct().join(nodes, "node").where("doc is not null").select("node", F.col("doc").alias("doc_id")), "candidates")
    wanted = maybe_in(texts, "doc_id", bitmap(candidates, "doc_id")).join(candidates, "doc_id")
    blobs = common.written(common.mapped(wanted.select("node", "text"), _bag_blobs, "node long, bag binary").dropDuplicates(["node"]), "bags")

    links = common.written(verified(pairs, blobs), "links")
    common.discard(pairs, candidates)
    roots = tops(links)
    common.discard(links)
    owner = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    named = common.spread_join(buckets.join(roots, "node", "left"), owner, "pivot", "node")
    named = named.select("band", "node", F.coalesce("root", "node").alias("root"), (F.coalesce("root", "node") != F.coalesce("pivot_root", "pivot")).alias("asks"))
    named = common.written(named, "named")
    common.discard(buckets)
    sides = named.groupBy("band").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("n"), F.ceil(F.count_if("asks") / SIDE).cast("int").alias("m")).where("m > 0")
    i, j = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in "mn")
    asking = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    answering = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
    placed = common.spread_join(named, sides, "band", "node").where("m is not null").withColumn("cell", F.explode(F.array_distinct(F.concat(asking, answering))))
    placed = placed.select(F.xxhash64("band", "cell").alias("block"), "node", "root", (F.col("asks") & (F.col("cell.i") == i)).alias("asks"), (F.col("cell.j") == j).alias("answers"))
    placed = placed.join(first.select("node", "short"), "node").join(blobs, "node").repartition("block").sortWithinPartitions("block")
    late = common.written(common.mapped(placed.select("block", "node", "root", "asks", "answers", "short", "bag"), _near(close), "a long, b long").distinct(), "links")
    common.discard(named, blobs)
    named = nodes.join(roots, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root"))
    if not late.isEmpty():  # few links: between classes, not between nodes
        ends = [roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab"]
        between = late.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(between.where("a <> b")).select(F.col("node").alias("root"), F.col("root").alias("top"))
        named = common.spread_join(named, joined, "root", "node").select("node", "doc", F.coalesce("top", "root").alias("root"))
    least = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    named = common.spread_join(named, least, "root", "node").select("node", "root", F.coalesce("class_id", "doc").alias("class_id"))
    found = common.spread_join(signed.select("doc_id", "node"), named, "node", "doc_id")
    return found.select("doc_id", "node", "root", F.coalesce("class_id", "doc_id").alias("class_id"))


def _with_bags(docs: DataFrame) -> DataFrame:
    """docs with the column _node, the hash of the text's bag."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "_bag_text"):
            *_, bag = bags(*shingles(*common.raw(batch.column("_bag_text"))), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(bag.view(np.int64))], [*columns, "_node"])

    common.tune(docs.sparkSession)
    whole = docs.withColumn("_bag_text", F.coalesce("text", F.lit("")))
    return common.mapped(whole, run, docs.withColumn("_node", F.lit(0).cast("long")).schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates: one with the least key, and of its texts the one whose hash is
    least; a row without a key stays only where the whole class has none. All columns stay.

    It decides by text, not by key: rows that share a key but not a text are apart, and none goes unless a row that is near
    its text stays. Only rows of keys that occur again, or that have a text which goes, are looked at; a bitmap of hashed
    keys finds them, and their bags are joined with the decisions."""
    columns = docs.columns
    found = common.written(classes(docs), "classes")
    texts = found.groupBy("doc_id", "node", "root").agg(F.count("*").alias("n"))
    stays = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    decided = common.spread_join(texts, stays, "root", "node").select("doc_id", "node", "n", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))).alias("keep"))
    decided = common.written(decided, "decided")
    odd = decided.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n").alias("n"), F.min("keep").alias("keep")).where("n > 1 or not keep").select("doc_id")
    odd = common.written(odd, "odd")
    bits = bitmap(odd, "doc_id")
    common.discard(found)
    keyed = docs.where("doc_id is not null")
    sure = maybe_in(keyed, "doc_id", bits, there=False)
    checked = _with_bags(maybe_in(keyed, "doc_id", bits).unionByName(docs.where("doc_id is null"))).withColumn("_key", F.col("doc_id").cast("long"))
    checked = checked.dropDuplicates(["_key", "_node"])
    goes = decided.where("not keep").select(F.col("doc_id").alias("_gone"), F.col("node").alias("_gone_node"))
    checked = checked.join(goes, F.col("_key").eqNullSafe(F.col("_gone")) & (F.col("_node") == F.col("_gone_node")), "left_anti")
    return sure.unionByName(checked.select(columns))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id")
