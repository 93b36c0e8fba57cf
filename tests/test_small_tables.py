"""Texts of unique keys meet a small table where they are read: nothing moves for it."""

import pytest
from pyspark.sql import functions as F

from taxolith.operators import features, hierarchy, sparse

ROWS = [(1, "aa bb aa cc", "x"), (2, "bb cc zz", "x"), (3, "dd dd cc", "y"), (None, "aa bb", "y"), (4, None, "y"), (5, "", "x"), (6, "bb aa bb", "x")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("terms", [1 << 20, 2, 1])
def test_texts_of_unique_keys_do_not_move(spark, monkeypatch, terms):
    monkeypatch.setattr(features, "SLICE", terms)
    docs = spark.createDataFrame(ROWS, "id long, t string, l string")
    for how in (features.Features(min_df=2), features.Features("count", 1, 2, min_df=2), features.Features("count", min_df=2, binary=True)):
        chosen = features.selected(features.term_counts(docs, "id", "t", how), 7, how)
        own = features.weighted(docs, chosen, 7, "id", "t", how)
        assert not any(x in plan(own) for x in ("Repartition", "Join", "CoGroup", "Aggregate"))
        monkeypatch.setattr(features, "unique", lambda *a: False)  # by buckets
        dealt = features.weighted(docs, chosen, 7, "id", "t", how)
        monkeypatch.undo()
        monkeypatch.setattr(features, "SLICE", terms)
        assert "CoGroup" in plan(dealt) and own.schema == dealt.schema
        assert own.count() and own.orderBy("id", "feature").collect() == dealt.orderBy("id", "feature").collect()
    none = features.weighted(docs.where("id > 3"), chosen.where("false"), 7, "id", "t", how)
    assert not none.collect() and not features.weighted(docs.where("false"), chosen, 7, "id", "t", how).collect()


def test_repeated_keys_are_one_text(spark):
    docs = spark.createDataFrame([*ROWS, (3, "ee cc", "y")], "id long, t string, l string")
    how = features.Features("count", min_df=1, max_df=1.0)
    weights, _, _ = features.fit_transform(docs, [], "id", "t", how)
    assert {r.feature: r.weight for r in weights.where("id = 3").collect()} == {"cc": 2.0, "dd": 2.0, "ee": 1.0}


def test_a_capped_model_sums_where_texts_are_read(spark):
    docs = spark.createDataFrame(ROWS, "id long, t string, l string")
    own = sparse.fit_table(docs, "id", "t", hierarchy.Tree.fit(docs, ["l"]), features.Features("count", min_df=2, max_df=1.0, most=3))
    sums = own.sums(docs, "id", "t")
    assert not any(x in plan(sums) for x in ("Repartition", "Join", "CoGroup"))
    twice = own.sums(docs.union(docs.where("id = 5")), "id", "t")  # a key that repeats: by buckets, the same sums
    assert "CoGroup" in plan(twice) and sums.orderBy("id").collect() == twice.orderBy("id").collect()
    assert {r.id: r["_known"] for r in sums.select("id", F.round("_known").alias("_known")).collect()} == {1: 4.0, 2: 2.0, 3: 1.0, 6: 3.0}


def test_a_known_term_is_a_row_a_block(spark, monkeypatch):
    docs = spark.createDataFrame([*ROWS, (7, "alone bb", None)], "id long, t string, l string")
    own = sparse.fit_table(docs, "id", "t", hierarchy.Tree.fit(docs, ["l"]), features.Features("count", min_df=1, max_df=1.0, most=None))
    tables, plain = [], features.met
    monkeypatch.setattr(features, "met", lambda *a, **b: tables.append(a[4]) or plain(*a, **b))
    sums = own.sums(docs, "id", "t")
    assert sorted((r.feature, r.block) for r in tables[0].collect()) == [("aa", 0), ("alone", sparse.KNOWN), ("bb", 0), ("cc", 0), ("dd", 0), ("zz", 0)]
    assert {r.id: (r["_known"], r["_words"], r["_square"]) for r in sums.collect()} == {1: (4, 4, 6), 2: (3, 3, 3), 3: (3, 3, 5), 6: (3, 3, 5), 7: (2, 2, 2)}
    assert {r.feature for r in own.weights.where("block < 0").collect()} == {"aa", "alone", "bb", "cc", "dd", "zz"}
