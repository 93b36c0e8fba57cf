"""op11 to op13: plain versions, odd rows, and their SQL."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolith.llm import divergence, prefix_trie, quality, queries

SF = "/root/testdata/sf0.01"
ODD = [(1, "", "en", "a"), (2, None, "en", "a"), (3, "the the the", None, None), (None, "Été the café", "fr", "b"), (4, "x" * 40_000 + " the", "en", "b"), (4, "x" * 40_000 + " the", "en", "b"), (5, "THE the2the\n\tThe", "en", "c"), (6, "1 2 3", "de", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(5)
    words = ["the", "of", "Étoile", "naïve", "ab", "AB", "zed", "q", "你好"]
    rows = ODD + [(100 + k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), rnd.choice(["en", "fr"]), rnd.choice("abcdefg")) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("p", F.lit("x")).repartition(5)


# ---- op11

def plain_features(text):
    """(feature, kind) in plain loops."""
    words, runs, last = [], [], None
    for word in re.split(rb"[\x00-\x20]+", text):
        if not word:
            continue
        words.append(word)
        if word == last:
            words.append(None)
        last = word
        padded = b" " + word + b" "
        runs += [padded[a : a + n] for n in quality.ORDERS for a in range(len(padded) - n + 1)]
    return words, runs


def bucket_of(part, whole):
    """Where the operator puts one word or run, from a text that holds nothing else of its kind."""
    data = np.frombuffer(part if whole else part, np.uint8)
    for _, bucket, kind in quality.features(data, np.array([0, len(data)])):
        if kind and whole:
            return int(bucket[0])


def test_quality_features_are_the_plain_ones():
    texts = [b"", b" \n ", b"ab ab", "Ünï the the the\ttoo".encode(), b"a", b"word" * 50]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = [[collections.Counter(), collections.Counter()] for _ in texts]
    for row, bucket, kind in quality.features(data, at):
        for r, b in zip(row.tolist(), bucket.tolist()):
            got[r][0 if kind else 1][b] += 1
    for text, (words, runs) in zip(texts, got):
        own_words, own_runs = plain_features(text)
        want = collections.Counter(quality.AGAIN if w is None else bucket_of(w, True) for w in own_words)
        assert words == want
        assert sum(runs.values()) == len(own_runs) and sorted(runs.values()) == sorted(collections.Counter(own_runs).values())  # no two of these share a bucket


def test_quality_scores_are_the_plain_softmax():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.standard_normal((1 << quality.BITS, quality.WIDTH)), rng.standard_normal((quality.WIDTH, 2)), rng.standard_normal(2))
    texts = [b"", b"one two two", "é".encode() * 30, b"a b c d " * 9]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.score(data, at, model.table())
    for k, text in enumerate(texts):
        hidden = np.zeros(quality.WIDTH)
        own, one = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        parts = list(quality.features(own, one))
        words = len([w for w in plain_features(text)[0] if w is not None])
        runs = len(plain_features(text)[1])
        for _, bucket, kind in parts:
            for b in bucket.tolist():
                hidden += model.vectors[b] * 0.5 / max(words if kind else runs, 1)
        z = np.exp(hidden @ model.out + model.bias)
        assert abs(got[k] - z[1] / z.sum()) < 1e-9
        row, bucket, weight = quality.averages(own, one)
        assert np.allclose(weight @ model.vectors[bucket] if len(bucket) else hidden * 0, hidden)


def test_op11_holds_out_a_fifth_and_is_right_there(spark):
    got = queries.QUERIES["op11_quality"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and dict(got.dtypes)["predicted"] == "int"
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    for label in (0, 1):
        own = [r.predicted == label for r in held if r.quality == label]
        assert len(own) > 5 and sum(own) >= 0.9 * len(own)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(100, 160)] + [(101, 0, 1), (None, 1, 0), (102, None, 0)], "doc_id long, quality int, toxic int")
    sample = {r.doc_id: r.quality for r in quality.sample(docs.unionByName(docs), labels).collect()}
    assert sample[101] == 0 and all(zlib.crc32(str(k).encode()) % 5 for k in sample)
    assert quality.sample(docs.unionByName(docs), labels, 3).count() == 6  # rows of a key count once
    model = quality.fit(docs, labels)
    scores = quality.scored(docs, model).collect()
    assert len(scores) == docs.count() and len({r.score for r in scores if r.doc_id in (1, 2)}) == 1 and len({r.score for r in scores if r.doc_id == 4}) == 1
    assert quality.scored(docs.where("false"), model).count() == 0
    for share, own in ((1.0, labels.where("quality = 1 and doc_id > 101")), (0.0, labels.where("quality = 0")), (1.0, labels.where("false"))):
        assert all(abs(r.score - share) < 1e-9 for r in quality.scored(docs, quality.fit(docs, own)).collect())


# ---- op12

def plain_audit(rows, most=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [(s, t) for l, s, t in texts if l == lang]
        df = collections.Counter(w for _, t in own for w in set(t))
        kept = [w for w in df if df[w] >= 3]
        count = {s: collections.Counter(w for o, t in own if o == s for w in t if df[w] >= 3) for s in {s for s, _ in own}}
        total = sum(count.values(), collections.Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        q, p = share(total), {s: share(c) for s, c in count.items()}
        for s in count:
            pair = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in count if o != s]
            term = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, cut in (("pair", pair, None), ("term", term, most)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found)]
    return sorted(out)


def test_op12_against_plain_loops(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    for sources, terms, most in ((32, 1024, 200), (2, 2, 3), (1, 1, 1)):
        monkeypatch.setattr(divergence, "SOURCES", sources)
        monkeypatch.setattr(divergence, "TERMS", terms)
        assert sorted(map(tuple, divergence.audit(docs, most).select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, most)
    assert divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 10 ** rng.randint(1, 13))
        count = rng.randint(0, total - 1)
        assert divergence.shares(np.array([count]), np.array([total]))[0] == 1 + 10**9 * (count + 1) // total


# ---- op13

def plain_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    members, whole = collections.defaultdict(list), {}
    for c in by:
        by[c].sort()
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
    for c in by:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple((r, x) for _, _, r, x in by.get(base, [])[:h]) + tuple((r, x) for _, _, r, x in by[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))) for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()), key=repr)


@pytest.mark.parametrize("block, fan, piece, parts", [(1 << 23, 64, 65536, 1), (1500, 3, 4, 7), (200, 2, 2, 30)])
def test_op13_against_plain_loops(spark, block, fan, piece, parts):
    rnd = random.Random(block)
    pick = lambda *xs: rnd.choice(xs)
    rows = [(c, None if t == 0 and rnd.random() < 0.2 else t, pick("u", "u", None, "a"), pick("x", "x", "yé", None, "zz zz")) for c in [*range(-20, 90), None] for t in range(rnd.randint(1, 11))]
    rows += [(1000 + 5 * k, t, "u", "the same") for k in range(40) for t in range(3)]  # one sequence of many conversations
    rows += [(5000, t, "u", "long" * 5000 if t == 7 else "t") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(0)).withColumn("key", F.lit("k"))
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert sorted(map(tuple, prefix_trie.trie(df, block, fan, piece).collect()), key=repr) == plain_trie(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)


def test_op13_of_repeated_rows_and_of_none(spark):
    rows = [(5, 0, "u", "a"), (5, 0, "u", "a"), (7, 1, None, None), (7, 1, None, None), (None, 0, "u", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, prefix_trie.trie(df).collect()), key=repr) == plain_trie(rows)
    assert prefix_trie.trie(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_prefix_trie"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
