"""Terms are counted within their texts, and texts meet tables of terms by buckets: no occurrence of a term moves."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolith.functions import tokens as N
from taxolith.operators import features, hierarchy, sparse, tokens

ROWS = [(1, "aa bb aa cc", "x"), (2, "bb cc zz", "x"), (3, "dd dd cc", "y"), (3, "dd ee", "y"), (None, "aa bb", "y"), (None, "aa", "y"), (4, None, "y"), (5, "", "x"), (6, "bb aa bb", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, t string, l string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_within_a_text(spark, docs):
    how = features.Features("count")
    got = features.term_counts(docs.where("id <> 3"), "id", "t", how)
    assert "Aggregate" not in plan(got) and "Repartition" not in plan(got)
    want = Counter((k, w) for k, t, _ in ROWS for w in (t or "").split())  # the texts of a key are one, also of a null key
    assert {(r.id, r.feature): r.tf for r in features.term_counts(docs, "id", "t", how).collect()} == want
    assert {(r.id, r.feature): r.tf for r in features.term_counts(docs, "id", "t", features.Features("count", binary=True)).collect()} == dict.fromkeys(want, 1)
    folded = docs.where("id = 6").select(N.ngrams(N.tokenize(F.col("t")), 1, 2, True).alias("g"))
    assert folded.first().g == ["bb", "aa", "bb", "aa bb", "aa bb"]


def test_the_choice_alone_says_what_a_space_holds(spark, docs):
    how = features.Features("count", 1, 2, min_df=2, max_df=1.0, most=None, binary=True, fold=True)
    own = features.sweep(docs, "id", "t", {"one": how})
    assert "Join" not in plan(own)
    n = docs.count()
    weights, _, chosen = features.fit_transform(docs, [], "id", "t", how)
    assert own.drop("name").collect() == features.density(weights, n, "id").collect()
    assert features.top_chosen(chosen, 3, n).collect() == features.top_features(weights, 3, n).collect()


@pytest.mark.parametrize("bucket", [8 << 20, 4])
def test_texts_meet_a_table_by_buckets(spark, docs, monkeypatch, bucket):
    monkeypatch.setattr(features, "BUCKET", bucket)
    monkeypatch.setattr(features, "PAIRS", 2)
    tree = hierarchy.Tree.fit(docs, ["l"])
    how = features.Features("count", min_df=2, max_df=1.0, most=None)
    for kind in ("bayes", "cosine"):
        own = sparse.fit_table(docs, "id", "t", tree, how, kind)
        weights = {(r.feature, r.block): r.w for r in own.weights.collect()}
        sums = own.sums(docs, "id", "t")
        assert "FlatMapCoGroups" in plan(sums)
        want = {}
        for k, t, _ in ROWS:
            for w in (t or "").split():
                if k is not None and (w, sparse.KNOWN) in weights:
                    want.setdefault(k, Counter())[w] += 1
        got = {r.id: r for r in sums.collect()}
        assert set(got) == set(want)
        for k, c in want.items():
            assert np.allclose(got[k]["_s"], sum(np.array(weights.get((w, 0), [0.0, 0.0])) * n for w, n in c.items()))
            assert (got[k]["_known"], got[k]["_square"]) == (sum(c.values()), sum(n * n for n in c.values()))
    words = spark.createDataFrame([("aa",), ("dd",)], "token string")
    one = docs.where("id is null or id <> 3")
    assert sorted(r.t for r in tokens.pruned(one, "id", "t", words).collect()) == ["", "", "", "", "", "aa", "aa aa"]
    vectors = spark.createDataFrame([("aa", [1.0, -1.0]), ("bb", [4.0, 2.0])], "token string, vector array<double>")
    for pool, want in {"mean": [3.0, 1.0], "sum": [9.0, 3.0], "max": [4.0, 2.0]}.items():
        assert {r.id: r.vector for r in features.document_vectors(docs.where("id > 3"), "id", "t", vectors, 2, pool).collect()} == {4: [0.0, 0.0], 5: [0.0, 0.0], 6: want}
    known = sparse.known_tokens(one, "id", "t", words.union(spark.createDataFrame([("aa bb",)], "token string")).withColumnRenamed("token", "feature"))
    assert {r.id: (r.n_tokens, r.n_known_tokens) for r in known.where("id is not null").collect()} == {1: (4, 2), 2: (3, 0), 4: (0, 0), 5: (0, 0), 6: (3, 1)}
