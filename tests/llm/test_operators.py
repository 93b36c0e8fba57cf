"""The training-data operators against brute force, the tokenizer libraries, round trips and held-out labels."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from taxolith.llm import bpe, common, decontamination, fingerprints, graphs, html_text, language, near_duplicates, packing, repeats, secrets, toxicity

SF = "/root/testdata/sf0.001"
RND = random.Random(11)


def letters(n, alphabet="abcdé "):
    return "".join(RND.choice(alphabet) for _ in range(n))


PASSAGE = letters(700)
ROWS = [(k, letters(RND.randint(0, 500)) + PASSAGE[(a := RND.randint(0, 250)) : a + RND.randint(300, 700)] + letters(RND.randint(0, 300))) for k in range(60)]
ROWS += [(200, "a" * 3000), (201, "ab" * 900 + "q"), (202, None), (203, ""), (204, "a" * 399), (205, "a" * 400), (206, ROWS[0][1]), (206, ROWS[0][1]), (None, ROWS[1][1]), (207, "x" + "ab" * 400), (208, PASSAGE * 2)]
ROWS += [(300, "don't WE'LL x''s 12½ <|endoftext|> İΣ ﬁ ▁▁ a  b\n\tc　d 😀"), (301, "<s>hi</s> <0x0A>"), (302, " "), (303, "é" * 300), (304, "word " * 2000)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, and other columns whose names clash with working ones."""
    names = ["doc_id", "text", "n_tokens", "spans", "base", "k", "score", "node", "part", "kind", "lang", "n_words"]
    return spark.createDataFrame([(i, t, *["x"] * 10) for i, t in ROWS], ", ".join(["doc_id long", "text string", *(f"{n} string" for n in names[2:])]))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def key(x):
    return -1 if x is None else x


def tokenizers_path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_token_counts_equal_the_library(spark, odd, empty):
    import sentencepiece
    from tokenizers import Tokenizer

    path = tokenizers_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in bpe.token_counts(odd, path).collect())
    assert got == sorted((key(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS)
    path = tokenizers_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    got = sorted((key(r.doc_id), r.n_tokens) for r in bpe.token_counts(odd, path).collect())
    assert got == sorted((key(i), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert bpe.token_counts(empty, path).count() == 0


def test_pre_tokens_fuzzed():
    import sentencepiece
    from tokenizers import Tokenizer

    alphabet = "ab ▁\n\t.,'éß日😀 eth1srelvmd"
    texts = ["".join(RND.choice(alphabet) for _ in range(RND.randint(0, 90))) for _ in range(800)] + ["ab" * 300, " " * 150, "日本語" * 60]
    pieces = bpe.Pieces(tokenizers_path("piece_bpe_32k.model"))
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_path("piece_bpe_32k.model"))
    assert pieces.counts(texts).tolist() == [len(x) for x in library.encode(texts)]
    words = bpe.WordIds(tokenizers_path("word_bpe_49k.json"))
    flat, counts = words.ids(texts)
    ends = np.cumsum(counts)
    want = Tokenizer.from_file(tokenizers_path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)
    assert [flat[e - c : e].tolist() for c, e in zip(counts, ends)] == [x.ids for x in want]


def test_memory_of_pre_tokens_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 64)
    pieces = bpe.Pieces(tokenizers_path("piece_bpe_32k.model"))
    texts = [letters(400) for _ in range(40)]
    one = [pieces.counts([t])[0] for t in texts]
    monkeypatch.undo()
    assert one == bpe.Pieces(tokenizers_path("piece_bpe_32k.model")).counts(texts).tolist()


def test_fingerprints(spark, odd, empty):
    rows = [r for r in ROWS if r[0] is not None]
    got = fingerprints.fingerprints(odd.where("doc_id is not null")).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = fingerprints.edited(t, following)
        a, b, c = (fingerprints.digests([x.encode()]) for x in (t, changed, following))
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), round(float(fingerprints.likeness(a, b)[0]), 9), round(float(fingerprints.likeness(a, c)[0]), 9)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert all(0 <= r.near_edited <= 1 for r in got)
    assert fingerprints.fingerprints(empty).count() == 0
    assert fingerprints.fingerprints(odd.where("doc_id = 200")).first().near_next == 1
    assert fingerprints.fingerprints(odd).count() == len(ROWS)


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">x</a></ul></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>first <br>line&nbsp;x<p>second<div class="comments"><p>nice</div></article><footer>&copy;</footer>'


def test_html_text(spark):
    long = "word " * 40
    cases = {
        PAGE: "A & B\nfirst line x\nsecond", None: "", "": "", "plain &lt; <3 you": "plain < <3 you", "<p>a<script>x": "a", "<p></p>": "",
        f'<div class="menu">a<ul><li>x</ul></div><div id=content><h2>T</h2><p>{long}<p>end</div><div class="footer">c</div>': f"T\n{long.strip()}\nend",
        '<article><p title="a > b">x</p><!-- <p>no</p> --><p>y</article>': "x\ny", "<form><p>a</form>": "", f"<p>{'z' * 200_000}": "z" * 200_000,
    }
    pages = spark.createDataFrame([(k, f"u{k}", p, "x") for k, p in enumerate(cases)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got == dict(enumerate(cases.values()))
    assert html_text.extracted(pages.where("false")).count() == 0


def test_html_text_of_generated_pages(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.op3_html_text(spark, SF).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_html_text_of_generated_pages_without_article_tags(spark):
    """Line blocks alone find the same text where no tag tells it."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        want = html_text.main_text(r.html)
        for tag in ("div", "section", "td"):
            assert html_text.main_text(r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")) == want


def test_html_deep_nesting_and_repeats(spark):
    page = "<div>" * 30_000 + f"<p>{'word ' * 100}" + "</i>" * 30_000
    pages = spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extracted(pages).collect()] == [("word " * 100).strip()] * 2


def test_html_density_chooses_the_text():
    long = "word " * 40
    text = html_text.main_text
    body = f"<p>{long}</p><p>end</p>"
    want = f"{long.strip()}\nend"
    box = '<div class="advert">buy</div>'
    assert text(f"<h1>T</h1>{box}<p>{long}</p>{box}<p>short</p>{box}<p>{long}</p>{box}<p>tail</p>") == f"T\n{long.strip()}\nshort\n{long.strip()}"
    assert text(f"<article><p>teaser</p></article>{box}<div>{body}</div>") == f"teaser\n{want}" or text(f"<article><p>teaser</p></article>{box}<div>{body}</div>") == want
    assert text(f"<main><p>{long}</p></main>{box}<div><p>{'x' * 90}</p></div>") == long.strip()


def test_html_named_containers_do_not_hide_the_article():
    long = "word " * 40
    text = html_text.main_text
    want = f"{long.strip()}\nend"
    for wrap in ("class='layout has-sidebar'", "class=no-sidebar", "class='content with-comments'", "id='promo-free-main'", "class='side wrapper'", "id=header"):
        for tag in ("article", "main", "section"):
            page = f"<div {wrap}><{tag}><p>{long}</p><p>end</p></{tag}><div class='main-nav'>links</div></div><div class='site-footer'>c</div>"
            assert text(page) == want, page
    assert text(f"<p>{long}</p><div class='ad-box'>buy</div><div class='comments-list'>nice</div>") == long.strip()


BASE = [(n, re.compile(p), g, m) for n, p, g, m in (("assign", secrets.ASSIGN, 2, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24))]


def base_spans(text):
    return sorted((x.start(), k, x.end(), n) for k, (n, p, g, m) in enumerate(BASE) for x in p.finditer(text or "") if len(x[g]) >= m)


def test_secrets(spark, odd, empty):
    rows = [(1001, "é password = 'abc123' x"), (1002, "secret: token=abcdefg; password = token: abcdefgh"), (1003, "API_KEY=short"), (1004, "AKIA" + "A" * 16 + " AKIA123 " + "0f" * 15), (1005, None), (1006, ""), (1007, "token=" + "ab" * 20), (1008, "TOKEN\":\"xx.yy-zz\"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = secrets.scanned(docs).select("doc_id", "text", "base").collect()
    assert len(got) == len(rows) + len(ROWS)
    assert all([tuple(s) for s in r.base] == base_spans(r.text) for r in got)
    assert secrets.scanned(empty).count() == 0
    masked = secrets.redacted(docs.withColumn("n_chars", docs.doc_id).withColumn("base", docs.text))
    assert masked.columns == ["doc_id", "text", "n_chars", "base"]
    by = {r.doc_id: r.text for r in masked.where("doc_id > 1000").collect()}
    assert by[1001] == "é [secret]' x" and by[1003] == "API_KEY=short" and by[1005] is None and by[1007] == "[secret]"


def test_secrets_in_a_text_with_very_many(spark):
    text = " ".join(f"é token={k:08d} AKIA{k:016d} {'0123456789abcdef' * 2}" for k in range(4000)) + " tail"
    docs = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in secrets.scanned(docs).select("doc_id", "base").collect()}
    assert got == {1: base_spans(text), 2: []}
    masked = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert masked == {1: " ".join("é [secret] [secret] [secret]" for _ in range(4000)) + " tail", 2: "none"}


def test_random_strings_are_found_and_names_are_not(spark):
    rnd = random.Random(5)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    good = [(k, "see " + "".join(rnd.choice(alphabet) for _ in range(40)) + " there") for k in range(20)]
    names = ["someVeryLongIdentifierName2023", "2024-report-final-version-two", "InternationalBusinessMachines", "https/path/to/some/Resource_name_here", "zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1"]
    docs = spark.createDataFrame(good + [(100 + k, n) for k, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: [s.name for s in r.spans] for r in secrets.scanned(docs).collect()}
    assert sum(got[k] == ["random"] for k in range(20)) >= 19
    assert not any(got[100 + k] for k in range(len(names)))


def test_rare_random_strings_of_each_encoding_are_found(spark):
    rnd = random.Random(9)
    words = "system user report index config service handler request response file path name version final data table export import backup image photo invoice order customer account session manager factory builder client".split()
    number = lambda: rnd.choice([str(rnd.randint(1990, 2026)), f"{rnd.randint(1990, 2026)}{rnd.randint(1, 12):02}{rnd.randint(1, 28):02}", f"{rnd.randint(0, 9999):06}", "0000", f"{rnd.randint(0, 10**7):010}"])
    hex_words = "face cafe bead dead beef fade deed feed added decade facade bad cab dab bed fed ace".split()

    def name(kind):
        if kind == "hex":
            return "".join(rnd.choice([number(), number(), rnd.choice(hex_words)]) for _ in range(9))[: rnd.choice([20, 24, 32, 40, 64])].upper()
        if kind == "base32":
            return re.sub("[^A-Z2-7]", "", "".join([rnd.choice(words) for _ in range(rnd.randint(3, 8))] + [number()]).upper())
        own = [rnd.choice([*words, number()]) for _ in range(rnd.randint(3, 8))]
        return rnd.choice([rnd.choice("-_/").join(own), "".join(w.capitalize() for w in own), "_".join(w.capitalize() for w in own)])

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = {"hex": "0123456789ABCDEF", "base32": upper + "234567", "base64": upper + upper.lower() + "0123456789+/"}
    ordinary = [("name", k, 0, name(k)) for k in alphabets for _ in range(3000)]
    planted = [("planted", k, n, "".join(rnd.choice(a) for _ in range(n))) for k, a in alphabets.items() for n in (20, 24, 32, 40, 64) for _ in range(8)]
    docs = spark.createDataFrame([(k, c, e, n, f"see {t} there") for k, (c, e, n, t) in enumerate(ordinary + planted)], "doc_id long, made string, encoding string, n int, text string")
    found = collections.defaultdict(list)
    for r in secrets.scanned(docs).collect():
        found[r.made, r.encoding, r.n].append(any(s.name == "random" for s in r.spans))
    shares = {k: float(np.mean(v)) for k, v in found.items()}
    print(shares)
    for k in alphabets:
        assert shares["name", k, 0] < 0.01
        assert np.mean([shares["planted", k, n] for n in (20, 24, 32)]) >= 0.5 and np.mean([shares["planted", k, n] for n in (40, 64)]) >= 0.8


def plain_repeats(rows, length=repeats.LENGTH):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        change = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                change[k] += 1
                change[k + length] -= 1
        gone = np.cumsum(change[:-1]) > 0
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((key(i), len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("block", [repeats.BLOCK, 5000, 0])
def test_repeats(odd, empty, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)  # the driver's: which buckets are refined
    got = repeats.removals(odd).collect()
    assert sorted((key(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept.hex()) for r in got) == plain_repeats(ROWS)
    assert repeats.removals(empty).count() == 0


def plain_passages(rows, n=51):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    docs = [(i, find(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows]
    seen = collections.defaultdict(set)
    for k, (_, w) in enumerate(docs):
        for a in range(len(w) - n + 1):
            seen[tuple(w[a : a + n])].add(k)
    return sorted((key(i), len({p for a in range(len(w) - n + 1) if len(seen[tuple(w[a : a + n])]) > 1 for p in range(a, a + n)})) for i, w in docs)


def test_passages_of_over_fifty_words(spark, odd):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdéF") for _ in range(rnd.randint(1, 5)))
    passages = [[word() for _ in range(rnd.randint(45, 90))] for _ in range(6)]
    rows = []
    for k in range(60):
        own = [word() for _ in range(rnd.randint(0, 80))] + rnd.choice(passages)[rnd.randint(0, 5) :] + [word() for _ in range(rnd.randint(0, 80))]
        rows.append((1000 + k, ", ".join(own + rnd.choice(passages) * rnd.randint(0, 2))))
    rows += [(2000, rows[0][1]), (2001, None), (2002, "a " * 200), (2003, "b " + "a " * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text")).repartition(3)
    got = repeats.removals(docs).select("doc_id", "passage_words").collect()
    assert sorted((key(r.doc_id), r.passage_words) for r in got) == plain_passages(rows + ROWS)


def test_difference_cover_order():
    assert all(any((i + d) % 64 in repeats.COVER and (j + d) % 64 in repeats.COVER for d in range(64)) for i in range(64) for j in range(64))
    base = [letters(500, "abc").encode() for _ in range(3)]
    pieces = [b"a" * 440, b"ab" * 210]
    for _ in range(60):
        b = bytearray(RND.choice(base))
        b[RND.randrange(500)] = 120
        a = RND.randint(0, 30)
        pieces.append(bytes(b[a : a + RND.randint(400, 463)]))
    starts = np.array([len(p) - 399 for p in pieces])
    seen = collections.Counter(p[i : i + 400] for p in pieces for i in range(len(p) - 399))
    assert repeats.repeated(pieces, starts).tolist() == [seen[p[i : i + 400]] > 1 for p in pieces for i in range(len(p) - 399)]


def plain_hits(docs, bench, window=10):
    find, low = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall, lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows = {}
    for i, t in bench:
        own = find(low(t))
        if own and i is not None:
            for k in range(max(len(own) - window, 0) + 1):
                windows.setdefault(tuple(own[k : k + window]), set()).add(str(i))
    out = []
    for i, t in docs:
        own, hit, items = find(low(t)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if found := windows.get(tuple(own[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        out.append((key(i), len(own), len(hit), ",".join(sorted(items))))
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination(spark, odd, empty, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    words = ["Alpha", "beta", "gämma", "42", "x", "y", "z"]
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 14)))) for k in range(12)] + [(50, None), (None, "alpha beta"), (51, "...")] + [(7, "beta, beta beta! beta beta beta beta beta beta beta beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, ", ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) + " " + (items[k % 12][1] or "") + "—beta") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = decontamination.with_hits(docs, bench).collect()
    assert sorted((key(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == plain_hits(rows + ROWS, items)
    clean = decontamination.cleaned(docs.withColumn("n_chars", docs.doc_id), bench)
    assert clean.columns == ["doc_id", "text", "n_chars"]
    clash = docs.withColumn("spans", docs.doc_id)
    assert decontamination.cleaned(clash, bench).select("spans").schema == clash.select("spans").schema
    short = {len(w) for w in (re.findall(r"\w+", t or "") for i, t in items if i is not None) if 0 < len(w) < 10}
    if not short:
        assert all(h == 0 for _, _, h, _ in plain_hits([(r.doc_id, r.text) for r in clean.collect()], items))
    assert decontamination.with_hits(empty, bench).count() == 0
    assert decontamination.with_hits(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_language_on_held_out_rows(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.fit(docs)
    got = {r.doc_id: r for r in language.identified(docs, network).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    strange = {key(r.doc_id): r for r in language.identified(odd, network).collect()}
    assert strange[202].lang_pred == strange[203].lang_pred == strange[302].lang_pred == "und" and strange[202].score == 0
    assert language.identified(empty, network).count() == 0
    assert language.fit(empty) is None and language.identified(odd, None).where("lang_pred <> 'und'").count() == 0


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizers_path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    rows = [(k, t) for k, (_, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(docs, path, length=256).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for cuts, size in [(sorted(pieces[i]), len(x)) for i, x in ids.items()] + [(sorted(v), None) for v in sequences.values()]:
        ends = np.cumsum([n for _, n in cuts])
        assert [a for a, _ in cuts] == [0, *ends[:-1]] and size in (None, ends[-1])
    lengths = [sum(n for _, n in v) for v in sequences.values()]
    assert all(n & (n - 1) == 0 and n <= 256 for n in lengths) and len(set(sequences)) == max(sequences) + 1
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(odd, path).agg({"length": "sum"}).first()[0] == sum(map(len, ids.values()))


def plain_bag(text):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = find(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return collections.Counter([text or ""])
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1)))


def plain_classes(rows):
    sets = [plain_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sum((sets[a] & sets[b]).values()) >= 0.8 * sum((sets[a] | sets[b]).values()):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [rows[find(k)][0] for k in range(len(rows))]


def test_near_duplicates(spark, empty):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 300))]
        for _ in range(rnd.randint(1, 9)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    common_passage = " ".join(word() for _ in range(80))
    rows += [(1000 + k, common_passage + " " + " ".join(word() for _ in range(60))) for k in range(40)]
    hub = [word() for _ in range(200)]  # copies that are near the first one but not near each other
    rows += [(500, " ".join(hub))] + [(501 + k, " ".join(word() if 12 * k <= i < 12 * k + 12 or 190 < i else w for i, w in enumerate(hub))) for k in range(15)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (2004, "..."), (2005, "a b c d e"), (2006, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(5)
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(docs).collect()}
    want = dict(zip([i for i, _ in rows], plain_classes(rows)))
    assert got == want
    kept = near_duplicates.deduplicated(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_duplicates.classes(empty).count() == 0


def test_tops_and_components(spark):
    rnd = random.Random(12)
    forest = [(k, rnd.randrange(max(0, k - 3), k)) for k in range(1, 300) if k % 7]
    up = dict(forest)

    def top(x):
        while x in up:
            x = up[x]
        return x

    links = spark.createDataFrame(forest, "a long, b long")
    want = {x: top(x) for pair in forest for x in pair}
    assert {r.node: r.root for r in graphs.tops(links).collect()} == want
    least = {}
    for x, t in want.items():
        least[t] = min(x, least.get(t, x))
    assert {r.node: r.root for r in graphs.components(links).collect()} == {x: least[t] for x, t in want.items()}
    assert graphs.tops(links.where("false")).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        v = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = rng.integers(1, 20, 200), rng.integers(1, 20, 200)
        s = near_duplicates.signatures(np.repeat([0, 1], 200), np.concatenate([v, v]), np.concatenate([a, b]), 2)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_the_slice():
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    own = [text(n) for n in (3, 12, 60, 150)] + ["again and again " * 40]

    def signed(texts):
        row, shingle, weight, _ = near_duplicates.bags(*near_duplicates.shingles(*common.raw(pa.array(texts))), len(texts))
        return near_duplicates.signatures(row, shingle, weight, len(texts))

    alone = np.concatenate([signed([t]) for t in own])
    for others in ([text(40) for _ in range(30)], [text(9000) for _ in range(4)], [text(300) for _ in range(300)]):
        together = signed(own + others)[: len(own)]
        assert (together.view(np.uint64) == alone.view(np.uint64)).all()
        assert (near_duplicates.band_keys(together) == near_duplicates.band_keys(alone)).all()


def test_toxicity_on_held_out_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.1"  # sf0.01 holds out only six toxic rows
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    got = {r.doc_id: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    held = [(got[i].score, y) for i, y in toxic.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    pairs = [(a > b) + 0.5 * (a == b) for a, y in held for b, z in held if y == 1 and z == 0]
    assert np.mean(pairs) > 0.9
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    scores = toxicity.scored(odd, model).collect()
    assert len(scores) == len(ROWS) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.scored(empty, model).count() == 0
    none = toxicity.fit(empty, labels)
    assert toxicity.scored(odd, none).where("score > 0.5").count() == 0
    assert toxicity.keep_clean(odd, none).columns == odd.columns


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(pipeline.STAGES)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    scores = model.score(*common.raw(pa.array([t for _, t in rows])))
    clean = common.written(stage["toxicity"](spark, docs, SF), "t")
    rows = [r for r, s in zip(rows, scores) if s < 0.5]
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, _ in rows]
    single = common.written(stage["near_dedup"](spark, clean, SF), "t")
    assert single.columns == docs.columns
    rows = [r for r, c in zip(rows, plain_classes(rows)) if r[0] == c]
    assert sorted(r.doc_id for r in single.collect()) == [i for i, _ in rows]
    cut = common.written(stage["decontamination"](spark, single, SF), "t")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {i: h for i, _, h, _ in plain_hits(rows, bench)}
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts.keys() == {i for i, _ in rows} and all((texts[i] == t) == (hits[i] == 0) for i, t in rows)
    assert not any(h for _, _, h, _ in plain_hits(texts.items(), bench))
    masked = common.written(stage["secrets"](spark, cut, SF), "t")
    assert masked.count() == len(rows) and all(not base_spans(r.text) and ("[secret]" in r.text) == bool(base_spans(texts[r.doc_id])) for r in masked.collect())
    packed = stage["packing"](spark, masked, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == texts.keys()


def bare(page):
    """The page without the tags and names that tell its parts: plain containers with meaningless classes."""
    page = re.sub(r"<(/?)(?:article|nav|header|footer|aside|form)\b", r"<\1div", page)
    return re.sub(r"""\b(class|id|role)=(?:"[^"]*"|'[^']*'|[^\s>"']+)""", r'\1="z"', page)


def f1(got, want):
    a, b = collections.Counter(got.split()), collections.Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / max(sum(a.values()) + sum(b.values()), 1) if a or b else 1.0


def test_html_text_by_line_lengths_alone(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    scores = [f1(html_text.main_text(bare(r.html)), html_text.main_text(r.html)) for r in pages]
    print(np.mean(scores), min(scores), np.mean([s == 1 for s in scores]))
    assert np.mean(scores) >= 0.98
    renamed = [f1(html_text.main_text(re.sub("</?article>", "", re.sub(r'class="[^"]*"', 'class="z"', r.html))), html_text.main_text(r.html)) for r in pages]
    print(np.mean(renamed))


def test_html_windows_surges_and_dives_are_the_plain_ones():
    rnd = random.Random(8)
    for _ in range(200):
        text = ["x" * rnd.choice([0, 0, 0, 1, 30, 90]) for _ in range(rnd.randint(1, 25))]
        window = [sum(len(t) for t in text[k : k + html_text.WINDOW]) for k in range(len(text))]
        runs, k = [], 0
        while k < len(text):
            if window[k]:
                z = k
                while z < len(text) and window[z]:
                    z += 1
                runs.append((k, z, max(window[k:z])))
                k = z
            k += 1
        surge, dive, peaks = html_text._stretches(text)
        assert list(zip(surge.tolist(), dive.tolist(), peaks.tolist())) == runs
