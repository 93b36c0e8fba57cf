"""Every op query and the pipeline, with all their columns, against plain versions on a small table of odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import ROWS, base_spans, key, letters, plain_classes, plain_hits, plain_passages, plain_repeats, tokenizers_path

from taxolith.llm import fingerprints, queries

RND = random.Random(21)
BENCH = [(k, " ".join(letters(6, "abcdef") for _ in range(RND.randint(3, 20)))) for k in range(8)]
DOCS = ROWS + [(400 + k, f"{letters(80)}. {BENCH[k % 8][1]}, password: 'hunter2{k}' {'0123456789abcdef' * 2} {letters(60)}") for k in range(12)]
KEYED = [(k, t) for k, (_, t) in enumerate(DOCS)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en" if k % 3 else "de", "src1", len(t or "")) for k, (i, t) in enumerate(DOCS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCH + [(90, None), (None, "x y")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    page = f"<html><body><nav>menu</nav><article><h1>Title</h1><p>{'word ' * 60}</p></article></body></html>"
    spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (None, "v", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def keyed(spark, sf, tmp_path_factory):
    """The same with a key of its own for every row."""
    path = str(tmp_path_factory.mktemp("keyed"))
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in KEYED], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    for name in ("benchmark", "labels", "pages"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return path


def rows_of(df):
    return sorted((tuple(key(x) for x in r) for r in df.collect()), key=repr)


def by_repr(rows):
    return sorted(rows, key=repr)


def test_op1(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_path("piece_bpe_32k.model"))
    want = [(key(i), len((t or "").encode()), n, n > 4096) for i, t in DOCS for n in [len(library.encode(t or ""))]]
    assert rows_of(queries.QUERIES["op1_token_counts"](spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit")) == by_repr(want)


def plain_digest(data):
    """The digest in plain loops."""
    counts = [0] * 128
    for a in range(len(data)):
        for k, (i, j, m) in enumerate(fingerprints.TRIPLETS):
            if a + m < len(data):
                h = (data[a + i] * 0x9E3779B1 + data[a + j] * 0x85EBCA77 + data[a + m] * 0xC2B2AE3D + k * 0x27D4EB2F) % 2**32
                h = ((h ^ h >> 15) * 0x2C1B3C6D) % 2**32
                counts[h >> 25] += 1
    q1, q2, q3 = (sorted(counts)[32 * k - 1] for k in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    packed = [sum(codes[a + k] << 2 * k for k in range(4)) for a in range(0, 128, 4)]
    length = int(np.floor(np.log(max(len(data), 1)) / np.log(1.1))) & 255
    third = max(q3, 1)
    return bytes([(sum(data) * 31 + len(data)) & 255, length, min(q1 * 15 // third, 15) << 4 | min(q2 * 15 // third, 15), *packed]), codes


def plain_likeness(x, y):
    (a, codes_a), (b, codes_b) = plain_digest(x), plain_digest(y)
    gap = sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(codes_a, codes_b))
    around = min(abs(a[1] - b[1]), 256 - abs(a[1] - b[1]))
    gap += around if around <= 1 else 12 * (around - 1)
    for shift in (4, 0):
        d = abs((a[2] >> shift & 15) - (b[2] >> shift & 15))
        gap += d if d <= 1 else 12 * (d - 1)
    return 1 - min(gap + (a[0] != b[0]), 300) / 300


def test_op2(spark, keyed):
    order = sorted(((i, t or "") for i, t in KEYED), key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        a, b = t.encode(), edited.encode()
        want[i] = (i, len(t), hashlib.sha256(b).hexdigest(), plain_digest(a)[0].hex(), plain_digest(b)[0].hex(), round(plain_likeness(a, b), 9), round(plain_likeness(a, after.encode()), 9))
    got = {r.doc_id: (*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in queries.QUERIES["op2_fingerprints"](spark, keyed).collect()}
    assert got == want


def test_op3(spark, sf):
    text = "Title\n" + ("word " * 60).strip()
    want = [(1, "u", text, len(text)), (1, "u", text, len(text)), (2, -1, "", 0), (-1, "v", "", 0)]
    assert rows_of(queries.QUERIES["op3_html_text"](spark, sf)) == by_repr(want)


def test_op4(spark, keyed):
    got = {r.doc_id: r for r in queries.QUERIES["op4_secrets"](spark, keyed).collect()}
    assert len(got) == len(KEYED)
    for i, t in KEYED:
        base, r = base_spans(t), got[i]
        names = collections.Counter(s[3] for s in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (names["assign"], names["access"], names["hex"])
        listed = [f"{n}:{a}:{b}" for a, _, b, n in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("random:")] == listed
        places = [(int(a), int(b)) for s in spans if s.startswith("random:") for _, a, b in [s.split(":")]]
        assert all(re.fullmatch(r"[A-Za-z0-9+/_-]{20,}={0,2}", t[a:b]) and not any(x < b and a < y for x, _, y, _ in base) for a, b in places)


def test_op5(spark, sf):
    got = queries.QUERIES["op5_repeats"](spark, sf).collect()
    assert by_repr((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == by_repr(plain_repeats(DOCS))
    assert sorted((key(r.doc_id), r.passage_words) for r in got) == plain_passages(DOCS)


def test_op6(spark, sf):
    want = [(i, n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0) for i, n, hit, x in plain_hits(DOCS, BENCH) for items in [x.split(",") if x else []]]
    assert rows_of(queries.QUERIES["op6_decontamination"](spark, sf)) == by_repr(want)
    assert any(w[-1] for w in want)


def test_op7(spark, sf):
    got = queries.QUERIES["op7_language"](spark, sf).collect()
    texts = collections.defaultdict(set)
    for i, t in DOCS:
        texts[i].add(t)
    assert len(got) == len(DOCS)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
        (text,) = texts[r.doc_id]
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))


def test_op8(spark, keyed):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizers_path("word_bpe_49k.json"))
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in KEYED}
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.QUERIES["op8_packing"](spark, keyed).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for own, size in [(v, len(ids[i])) for i, v in pieces.items()] + [(v, None) for v in places.values()]:
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [a for a, _ in own] == [0, *ends[:-1]] and size in (None, ends[-1]) and ends[-1] <= max(4096, size or 0)
    assert pieces.keys() == ids.keys()
    assert all((n := sum(x for _, x in v)) & (n - 1) == 0 for v in places.values())  # no padding at all


def test_op9(spark, keyed):
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_near_duplicates"](spark, keyed).collect()}
    assert got == dict(zip([i for i, _ in KEYED], plain_classes(KEYED)))


def test_op9_recall_on_the_given_table(spark):
    """All pairs of the table that share a shingle of fewer than 60 documents and reach 0.8 are in one class."""
    from test_operators import plain_bag

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bags, where = [plain_bag(t) for _, t in rows], collections.defaultdict(list)
    for k, b in enumerate(bags):
        for s in b:
            where[s].append(k)
    pairs = {(a, b) for own in where.values() if 1 < len(own) < 60 for x, a in enumerate(own) for b in own[x + 1 :]}
    near = [(a, b) for a, b in pairs if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())]
    got = {r.doc_id: r.class_id for r in queries.QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert len(near) > 50 and np.mean([got[rows[a][0]] == got[rows[b][0]] for a, b in near]) >= 0.99


def test_op10(spark, sf):
    got = queries.QUERIES["op10_toxicity"](spark, sf).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert r.held_out == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_pipeline_run_equals_its_stages(spark, keyed):
    import corpus_pipeline as pipeline
    from tokenizers import Tokenizer

    docs, names = spark.read.parquet(f"{keyed}/documents.parquet"), []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, keyed)
        names.append(name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets"]
    whole = Tokenizer.from_file(tokenizers_path("word_bpe_49k.json"))
    want = {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = pipeline.run(spark, keyed).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())


def test_pipeline_stages_on_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows, own columns with clashing names, and empty tables."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' AS node", "1 AS spans", "'y' AS base", "2 AS n_words", "3 AS part")
    out = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns and out.where("node <> 'x' or spans <> 1 or base <> 'y' or n_words <> 2 or part <> 3").count() == 0, name
    assert pipeline.STAGES[-1][1](spark, out, sf).count() >= out.count() > 0
    path = str(tmp_path / "empty")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    assert pipeline.run(spark, path).count() == 0
