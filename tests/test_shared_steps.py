"""What several readers or folds need is moved, or counted, once."""

import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxolith.operators import features, hierarchy, sparse, splits, tokens
from taxolith.plans import crossval

ROWS = [(1, "aa bb aa cc", "x"), (2, "bb cc zz", "x"), (3, "dd dd cc", "y"), (4, None, "y"), (5, "", "x"), (6, "bb aa bb", "x"), (7, "cc dd ee", "z")]


def test_texts_move_once_to_meet_a_table(spark, monkeypatch):
    monkeypatch.setattr(features, "BUCKET", 8)
    docs = spark.createDataFrame(ROWS, "id long, t string, l string")
    terms = spark.createDataFrame([("aa",), ("bb",), ("dd",)], "feature string")
    out = sparse.known_tokens(docs, "id", "t", terms)
    assert {r.id: (r.n_tokens, r.n_known_tokens) for r in out.collect()} == {1: (4, 3), 2: (3, 1), 3: (3, 2), 4: (0, 0), 5: (0, 0), 6: (3, 3), 7: (3, 1)}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_terms_are_looked_up_in_as_many_tasks_as_the_texts_need(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"aa w{k}") for k in range(50)], "id long, t string")
    terms = spark.createDataFrame([("aa",), ("w7",)], "feature string")
    for bucket, tasks in ((5, 15), (8, 10), (1000, 1)):
        monkeypatch.setattr(features, "BUCKET", bucket)
        assert features.buckets(docs, "t") == -(-290 // bucket)
        out = sparse.known_tokens(docs, "id", "t", terms)
        assert {r.id: r.n_known_tokens for r in out.collect()} == {k: 1 + (k == 7) for k in range(50)}
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        if tasks > 1:  # whatever the session's number of partitions
            assert set(re.findall(r"hashpartitioning\(feature#\d+, (\d+)\)", plan)) == {str(tasks)}


def test_folds_sum_counts_that_are_taken_once(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame(ROWS * 3, "id long, t string, l string").withColumn("id", F.monotonically_increasing_id())
    bad = docs.where("id % 4 = 1").select("id")
    how = features.Features("count", 1, 2, min_df=2, max_df=1.0, most=None)
    calls, plain = [], features.term_counts
    monkeypatch.setattr(features, "term_counts", lambda *a, **b: calls.append(1) or plain(*a, **b))
    for model, listed in (("multinomial_nb", None), ("centroid", bad)):
        calls.clear()
        path = f"file://{tmp_path}/{model}"
        crossval.run_recipe(spark, docs, path, "id", "t", ["l"], how, k=3, blacklist=listed, model=model)
        assert len(calls) == 1  # and not one a fold
        rows = splits.id_hash_fold(docs, "id", 3)
        got = crossval.status(spark, path, 3).collect()
        for f in range(3):
            want, _, learned = crossval.recipe_fold(rows, f, "id", "t", ["l"], how, model, listed)
            assert (got[f].features, got[f].paths) == (learned["features"], learned["paths"])
            done = spark.read.parquet(f"{path}/fold={f}")
            columns = [c for c in done.columns if c.startswith(("id", "pred", "conf", "winnable"))]
            assert done.select(columns).orderBy("id").collect() == want.select(columns).orderBy("id").collect()


def test_weights_lie_in_blocks(spark):
    rows = [(i, f"aa w{i % 3} w{i % 3}", f"c{i:03d}") for i in range(150)] + [(200, "aa aa", None), (201, "alone", None)]
    docs = spark.createDataFrame(rows, "id long, t string, l string")
    tree = hierarchy.Tree.fit(docs, ["l"])
    for most, terms in ((None, {"aa", "w0", "w1", "w2", "alone"}), (2, {"aa", "w0"})):
        own = sparse.fit_table(docs, "id", "t", tree, features.Features("count", min_df=1, max_df=1.0, most=most))
        weights = {(r.feature, r.block): r.w for r in own.weights.collect()}
        assert {t for t, b in weights if b == sparse.KNOWN} == terms and own.n_terms == len(terms)
        assert sorted(b for t, b in weights if t == "aa") == [-1, 0, 1, 2] and not [b for t, b in weights if t == "alone" and b >= 0]
        assert all(len(w) == sparse.BLOCK for (_, b), w in weights.items() if b >= 0)
        for i, text, label in rows[:150]:
            k = tree.classes[0].index(label)
            assert weights["aa", k // 64][k % 64] == pytest.approx(math.log(2))
            if f"w{i % 3}" in terms:
                assert weights[f"w{i % 3}", k // 64][k % 64] == pytest.approx(math.log(3)) and weights["w0", 0][1] == 0


def test_ngrams_move_once_and_are_counted_in_slices(spark, monkeypatch):
    rows = [("aa bb aa bb aa", "x"), ("bb cc", None), (None, "y"), ("", "y"), ("aa bb", "y"), ("cc", None), ("bb cc dd ee ff", "x"), ("aa bb", "x")]
    docs = spark.createDataFrame(rows, "t string, l string")
    want = {}
    for t, label in rows:
        words = (t or "").split()
        for g in {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}:
            want.setdefault(g, []).append(label)
    want = {g: (len(g.split()), len(c), len(set(c))) for g, c in want.items()}
    monkeypatch.setattr(features, "BUCKET", 8)
    out = tokens.ngram_counts(docs, "t", "l", 1, 3)
    assert {r.ngram: (r.n, r.doc_count, r.n_classes) for r in out.collect()} == want
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("hashpartitioning") == 1
    assert {r.ngram: (r.n, r.doc_count, r.n_classes) for r in tokens.ngram_counts(docs, "t", None, 2, 3, min_count=2).collect()} == {g: (n, c, 0) for g, (n, c, _) in want.items() if n > 1 and c > 1}
    none = docs.where("t is null")
    assert not tokens.ngram_counts(none, "t", "l", 1, 2).collect() and not tokens.ngram_counts(docs.where("false"), "t", "l").collect()
    whole = pa.RecordBatch.from_arrays([pa.array([r[1] or "\0" for r in rows]), pa.array([(r[0] or "").split() for r in rows])], ["_l", "_t"])
    for most in (1, 4, 100):
        monkeypatch.setattr(tokens, "SLICE", most)
        for batches in ([whole], [whole.slice(0, 3), whole.slice(3, 0), whole.slice(3)]):
            parts = list(tokens._slices(iter(batches)))
            assert [x for p in parts for x in p[1].to_pylist()] == whole.column(1).to_pylist()
            assert all(len(p[1].flatten()) <= max(most, max(map(len, p[1].to_pylist()))) for p in parts)
            got = {}
            for p in parts:
                for b in tokens._counted(*p, 1, 3):
                    for r in b.to_pylist():
                        got.setdefault(r["ngram"], []).append((r["_l"], r["_n"]))
            assert {g: (len(g.split()), sum(n for _, n in c), len({x for x, _ in c})) for g, c in got.items()} == want
