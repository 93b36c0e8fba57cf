"""What repeated keys, null keys and equal texts leave, and that a fit reads a key once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolith.llm import language, near_duplicates, toxicity

RND = random.Random(31)


def text(n=60):
    return " ".join("".join(RND.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def near(t):
    return t + " one word"


A, B, C, D, E = (text() for _ in range(5))
ROWS = [(1, A, "x"), (2, A, "y"), (2, B, "y"), (3, C, "z"), (3, D, "z"), (3, near(A), "z"), (None, E, "n"), (None, E, "n"), (None, near(B), "n"), (4, "", "e"), (4, None, "e"), (5, "", "e"), (6, near(E), "w"), (6, near(E), "v")]


def plain(rows):
    """The classes: bags at 0.8 or more, where a bag that only rows without a key have can only match equal ones."""
    def bag(t):
        w = (t or "").split()
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}

    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = bag(rows[i][1]), bag(rows[j][1])
            keyed = all(any(k is not None and bag(t) == x for k, t, _ in rows) for x in (a, b))
            if a == b or keyed and len(a & b) >= 0.8 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [[rows[k] for k in range(len(rows)) if group[k] == g] for g in sorted(set(group))]


@pytest.mark.parametrize("parts", [1, 7])
def test_one_row_of_each_class_stays_whatever_the_keys(spark, parts):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, more string").withColumn("node", F.lit("clash")).repartition(parts)
    out = near_duplicates.deduplicated(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text or "") for r in out.collect()]
    groups = plain(ROWS)
    assert len(got) == len(groups)
    for group in groups:
        mine = [g for g in got if g in [(k, t or "") for k, t, _ in group]]
        keys = [k for k, _, _ in group if k is not None]
        assert len({g for g in mine}) == 1 and mine[0][0] == (min(keys) if keys else None)
    assert near_duplicates.deduplicated(df.where("false")).count() == 0
    assert near_duplicates.deduplicated(df.where("doc_id is null")).count() == 2


def test_fits_read_a_key_once(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k} {text(5)}", "en") for k in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(4)], "doc_id long, quality int, toxic int")
    learned = [k for k in range(4) if __import__("zlib").crc32(str(k).encode()) % 5]
    assert toxicity.sample(docs, labels).count() == len(learned)
    seen = language.fit(docs)
    assert seen.languages == ["en"]


def test_toxicity_scores_are_the_plain_ones():
    rng = np.random.default_rng(2)
    texts = [b"", b"abcd", "Äbc ABC abc".encode(), b"xyz" * 40]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def code(gram):
        value = gram[0]
        for c in gram[1:]:
            value = (value * 0x01000193 + c) % 2**32
        spread = (value * 0x9E3779B1 + len(gram) * 0x85EBCA6B) % 2**32
        return (((spread ^ spread >> 15) * 0x2C1B3C6D) % 2**32) >> (32 - toxicity.BITS)

    def plain_features(t):
        low = bytes(c + 32 if 65 <= c < 91 else c for c in t)
        return {code(low[a : a + n]) for n in toxicity.ORDERS for a in range(len(low) - n + 1)}

    some = sorted(plain_features(texts[2]) | plain_features(texts[3]))[::2]
    keep = np.zeros(1 << toxicity.BITS, np.uint16)
    keep[some] = np.arange(1, len(some) + 1)
    model = toxicity.Model(keep, rng.standard_normal(len(some)), 0.3)
    for t, got in zip(texts, model.score(data, at)):
        total = 0.3 + sum(model.weight[keep[f] - 1] for f in plain_features(t) if keep[f])
        assert abs(got - 1 / (1 + np.exp(-total))) < 1e-9


def test_network_probabilities_are_the_plain_ones():
    net = language.Network.fresh(["a", "b", "c"], 3)
    for b in net.bias:
        b += 0.1
    batch = np.random.default_rng(4).integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    got = net.probabilities(batch, net.tables())
    for row, p in zip(batch, got):
        pooled = []
        for f, bias in zip(net.filters, net.bias):
            width = len(f)
            responses = [[sum(float(net.embedding[row[a + j]] @ f[j][:, k]) for j in range(width)) + float(bias[k]) for k in range(language.FILTERS)] for a in range(language.WINDOW - width + 1)]
            pooled += [max(0.0, max(r[k] for r in responses)) for k in range(language.FILTERS)]
        z = np.array(pooled) @ net.out + net.out_bias
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-4)


def test_all_pairs_of_a_bucket_can_be_tested(spark):
    words = [text(1) for _ in range(120)]
    rows = [(k, " ".join(words[: 60 + k] + [text(1) for _ in range(RND.randint(0, 6))])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pick = lambda close: sorted((r.doc_id, r.class_id) for r in near_duplicates.classes(df, close=close).collect())
    assert pick(0.0) == pick(near_duplicates.CLOSE)
