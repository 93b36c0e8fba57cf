"""Fits by sums, term tables and the tree walk, against plain numpy and plain loops."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.operators import evaluation, features, filters, gradients, hierarchy, models, network, sparse
from taxolith.plans import queries
from taxolith.plans.score import score
from taxolith.sources import bundle

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def parted(spark):
    """Three classes in four dimensions that lines can part, and one row of no class."""
    middle = np.array([[3, 0, 0, 1], [0, 3, 0, 1], [0, 0, 3, 1]])
    rows = [(k, [float(x) for x in middle[k % 3] + RNG.standard_normal(4)], "abc"[k % 3]) for k in range(240)]
    return spark.createDataFrame([*rows, (999, [0.0] * 4, None)], "id long, x array<double>, label string").repartition(3)


def test_quasi_newton_and_conjugate_gradients_find_the_minimum():
    a = RNG.standard_normal((30, 12))
    h, b = a.T @ a + np.eye(12), RNG.standard_normal((12, 3))
    assert np.allclose(gradients.solved(lambda p: h @ p, b), np.linalg.solve(h, b), atol=1e-5)
    x, path = gradients.minimised(lambda v: (0.5 * v @ h @ v - b[:, 0] @ v, h @ v - b[:, 0]), np.zeros(12), 100)
    assert np.allclose(x, np.linalg.solve(h, b[:, 0]), atol=1e-4) and all(p >= q for p, q in itertools.pairwise(path))


def test_sparse_rows_times_and_turned():
    m = RNG.standard_normal((7, 3))
    x = np.where(RNG.random((5, 7)) < 0.4, RNG.standard_normal((5, 7)), 0)
    x[2] = 0
    column = pa.array([{"places": np.flatnonzero(r).tolist(), "values": r[np.flatnonzero(r)].tolist()} for r in x], pa.struct([("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    for part in (slice(0, 5), slice(1, 4), slice(2, 3)):
        rows = gradients.Rows(column[part.start : part.stop])
        assert np.allclose(rows.times(m), x[part] @ m)
        right, out = RNG.standard_normal((rows.n, 2)), np.zeros((7, 2))
        rows.turned(right, out)
        assert np.allclose(out, x[part].T @ right)


def test_support_vectors_part_what_can_be_parted(parted):
    tree = hierarchy.Tree.fit(parted, ["label"])
    own = models.fit_levels(parted, tree, "x", "linear_svc")
    slopes = np.array([f[2] for f in own.models[0].fits])
    assert (slopes > 0).all()
    df, probs = own.probabilities(parted, "x")
    rows = tree.encode(df).select("code_label", F.col(probs[0]).alias("p")).where("code_label >= 0").collect()
    assert all(abs(sum(r.p) - 1) < 1e-6 for r in rows)
    assert sum(int(np.argmax(r.p)) == r.code_label for r in rows) > 0.9 * len(rows)


def test_curves_of_margins_without_signal_are_level(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(k, [float(v) for v in rng.standard_normal(3)], "ab"[k % 2]) for k in range(60)], "id long, x array<double>, label string")
    own = models.fit_levels(rows, hierarchy.Tree.fit(rows, ["label"]), "x", "linear_svc")
    assert all(s >= 0 for f in own.models[0].fits for s in f[2])
    one = rows.where("id < 1")
    lone = models.fit_levels(one, hierarchy.Tree.fit(one, ["label"]), "x", "linear_svc").probabilities(one, "x")[0].first()
    assert lone.p_label == [1.0]


def closed_ridge(x, y, n, alpha):
    mean, target = x.mean(0), np.eye(n)[y]
    w = np.linalg.solve((x - mean).T @ (x - mean) + alpha * np.eye(x.shape[1]), (x - mean).T @ (target - target.mean(0)))
    return w, target.mean(0) - mean @ w


def test_ridge_by_products_is_the_closed_form(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    how = features.Features("count", min_df=12, max_df=1.0, most=None, binary=True)
    terms = sparse.term_table(docs, "doc_id", "text", how)
    rows = sparse.sparse_rows(docs, "doc_id", "text", how, terms)
    tree = hierarchy.Tree.fit(docs, ["lang"])
    got = tree.encode(rows).collect()
    d = terms.count()
    assert sorted(r.place for r in terms.collect()) == list(range(d))
    x = np.zeros((len(got), d))
    for k, r in enumerate(got):
        x[k, r.features.places] = r.features["values"]
    y = np.array([r.code_lang for r in got])
    want, bias = closed_ridge(x, y, 4, 5.0)
    for numbers in (4_000_000, 2 * d):  # all classes at once, and two by two
        monkeypatch.setattr(models, "NUMBERS", numbers)
        own = models.fit_levels(rows, tree, "features", "ridge", alpha=5.0).models[0]
        assert np.allclose(np.array(own.weights).T, want, atol=1e-4) and np.allclose(own.bias, bias, atol=1e-4)
    margins = {r.doc_id: r.m for r in rows.select("doc_id", own.margins("features").alias("m")).collect()}
    assert all(np.allclose(margins[r.doc_id], x[k] @ want + bias, atol=1e-3) for k, r in enumerate(got))


def test_wide_dense_fits_are_the_narrow_ones(parted, monkeypatch):
    tree = hierarchy.Tree.fit(parted, ["label"])
    narrow = [models.fit_levels(parted, tree, "x", "ridge").models[0], models.fit_levels(parted, tree, "x", "lda", shrinkage=0.3).models[0]]
    monkeypatch.setattr(models, "WIDE", 2)
    monkeypatch.setattr(models, "LITERALS", 2)
    wide = [models.fit_levels(parted, tree, "x", "ridge").models[0], models.fit_levels(parted, tree, "x", "lda", shrinkage=0.3).models[0]]
    for a, b in zip(narrow, wide):
        assert np.allclose(a.weights, b.weights, atol=1e-4) and np.allclose(a.bias, b.bias, atol=1e-4)
    with pytest.raises(ValueError, match="shrinkage"):
        models.fit_levels(parted, tree, "x", "lda")
    p = [r[0] for r in parted.select(wide[0].probabilities("x")).collect()]
    assert all(abs(sum(x) - 1) < 1e-9 for x in p)


def test_network_gradient_and_forward_pass(spark):
    net = network.Network.fresh(6, 5, [2, 3], 1)
    x = RNG.standard_normal((9, 6))
    codes = np.stack([RNG.integers(-1, 2, 9), RNG.integers(-1, 3, 9)], 1)
    rows = gradients.Rows(pa.array(x.tolist()))
    out = np.zeros(net.flat().size)
    net.loss(rows, codes, [0.3, 2.0], out)
    flat = net.flat()
    for k in RNG.choice(len(flat), 30, replace=False):
        step = np.zeros(len(flat))
        step[k] = 1e-6
        slope = (net.shaped(flat + step).loss(rows, codes, [0.3, 2.0]) - net.shaped(flat - step).loss(rows, codes, [0.3, 2.0])) / 2e-6
        assert abs(slope - out[k]) < 1e-5
    hidden = [max(0.0, sum(x[0, j] * net.first[j, u] for j in range(6)) + net.first[6, u]) for u in range(5)]
    z = [sum(hidden[u] * net.heads[1][u, c] for u in range(5)) + net.heads[1][5, c] for c in range(3)]
    assert np.allclose(net.probabilities(rows, 1)[0], np.exp(z) / np.exp(z).sum())


def test_joint_network_beats_separate_models(spark):
    rows = queries._vectors(spark, "/root/testdata/sf0.001")
    tree = hierarchy.Tree.fit(rows, queries.LEVELS)
    joint = network.fit_network(rows, tree, "embedding", hidden=64, weights=[0.25, 0.75], steps=60)
    loss = {}
    for name, own in (("joint", joint), ("gaussian_nb", models.fit_levels(rows, tree, "embedding", "gaussian_nb")), ("centroid", models.fit_levels(rows, tree, "embedding", "centroid"))):
        df, probs = own.probabilities(tree.encode(rows), "embedding")
        loss[name] = evaluation.weighted_loss(df, probs, ["code_l1", "code_l2"], [0.25, 0.75]).first().loss
    assert loss["joint"] < min(loss["gaussian_nb"], loss["centroid"])
    steps = models.history(joint, spark).where("level = 'l1'").orderBy("step").collect()
    assert steps[0].objective > steps[-1].objective
    with pytest.raises(ValueError, match="weights"):
        network.fit_network(rows, tree, "embedding", weights=[1.0])


def plain_paths(tree, p, mode, k):
    shares = [{q: max(p[d][q[-1]], A.FLOOR) for q in tree.prefixes[d + 1]} for d in range(len(p))]
    scores = []
    for path in tree.paths:
        s = 0.0
        for d in range(len(path)):
            own = shares[d][path[: d + 1]]
            whole = sum(v for q, v in shares[d].items() if q[:-1] == path[:d]) if mode == "conditional" else 1.0
            s += math.log(own) - math.log(whole)
        scores.append(s)
    total = sum(map(math.exp, scores))
    order = sorted(range(len(scores)), key=lambda j: (-scores[j], j))[:k]
    return [(j, math.exp(scores[j]) / total) for j in order], [math.exp(s) / total for s in scores]


@pytest.mark.parametrize("mode", ["independent", "conditional"])
def test_walk_over_the_tree_is_exact(spark, mode):
    rnd = random.Random(4)
    paths = {(str(rnd.randint(0, 3)), str(rnd.randint(0, 5)), str(rnd.randint(0, 8)), str(rnd.randint(0, 9))) for _ in range(120)}
    tree = hierarchy.Tree.fit(spark.createDataFrame(sorted(paths), "a string, b string, c string, d string"), list("abcd"))
    rng = np.random.default_rng(6)
    draws = [[rng.dirichlet(np.full(n, shape)).tolist() for n in tree.sizes] for shape in (0.05, 0.3, 1.0, 30.0) for _ in range(6)]
    draws += [[[1 / n] * n for n in tree.sizes], [[0.0] * (n - 1) + [1.0] for n in tree.sizes]]  # all alike, and one class alone
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(draws)], "id int, p_a array<double>, p_b array<double>, p_c array<double>, p_d array<double>")
    probs = [f"p_{c}" for c in "abcd"]
    found = {r.id: r for r in hierarchy.trie_masses(hierarchy.trie_paths(df, tree, probs, mode, 3), tree, probs, mode).collect()}
    old = {r.id: r for r in hierarchy.prefix_masses(hierarchy.best_paths(hierarchy.path_scores(df, tree, probs, mode), tree, 3), tree).collect()}
    for k, p in enumerate(draws):
        best, every = plain_paths(tree, p, mode, 3)
        assert [x.path for x in found[k].paths] == [j for j, _ in best] == [x.path for x in old[k].paths]
        assert np.allclose([x.probability for x in found[k].paths], [q for _, q in best])
        for d in range(1, 5):
            mass = {}
            for path, q in zip(tree.paths, every):
                mass[path[:d]] = mass.get(path[:d], 0) + q
            ordered = sorted(mass.values(), reverse=True)
            assert math.isclose(found[k][f"mass_{d}"], ordered[0], rel_tol=1e-9) and math.isclose(found[k][f"margin_{d}"], old[k][f"margin_{d}"], abs_tol=1e-9)
    peaked = [found[k].n_scored for k in range(6)]
    assert max(peaked) < len(tree.paths) * 4 / 2  # a path has four steps


def test_term_table_models_and_their_bundle(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb aa", "x"), (2, "bb cc", "x"), (3, "dd dd cc", "y"), (4, None, "y"), (5, "zz", "z")], "id long, t string, l string")
    tree = hierarchy.Tree.fit(docs.where("id <> 5"), ["l"])
    how = features.Features("count", min_df=1, max_df=1.0, most=None)
    own = sparse.fit_table(docs, "id", "t", tree, how)
    count, rows = {"x": {"aa": 2, "bb": 2, "cc": 1}, "y": {"dd": 2, "cc": 1}}, {"x": 2, "y": 2}
    for r in own.probabilities(docs, "id", "t")[0].collect():
        tokens = (r.t or "").split()
        logs = [math.log((rows[c] + 1) / (4 + 2)) + sum(math.log((count[c].get(w, 0) + 1) / (sum(count[c].values()) + 5)) for w in tokens) for c in "xy"]
        want = np.exp(np.array(logs) - max(logs))
        assert np.allclose(r.p_l, want / want.sum()) and (r.n_tokens, r.n_known_tokens) == (len(tokens), len(tokens))
    path = str(tmp_path / "bundle")
    bundle.save(spark, path, bundle.Bundle(own, thresholds={"level": {1: 0.5}}))
    again = bundle.load(spark, path)
    pick = lambda b: sorted(map(tuple, score(docs.drop("l"), b, text_col="t", key="id").select("id", "predicted_l", "review_reason").collect()))
    assert pick(again) == pick(bundle.Bundle(own, thresholds={"level": {1: 0.5}})) and len(pick(again)) == 5
    with pytest.raises(ValueError, match="key"):
        score(docs, again, text_col="t")


def test_scoring_refuses_absent_columns(spark, parted):
    tree = hierarchy.Tree.fit(parted, ["label"])
    b = bundle.Bundle(models.fit_levels(parted, tree, "x"))
    for how in ({"features": "gone"}, {"features": "x", "carry": ["gone"]}, {"text_col": "gone"}, {"text_col": "label", "markers": {"gone": {"prefix": "V_"}}}):
        with pytest.raises(ValueError, match="gone"):
            score(parted, b, **how)


def test_logistic_is_the_penalised_maximum(parted):
    rows = parted.where("label is not null")
    tree = hierarchy.Tree.fit(rows, ["label"])
    p = {r.id: r.p_label for r in models.fit_levels(rows, tree, "x", "logistic").probabilities(rows, "x")[0].collect()}
    data = sorted(rows.collect(), key=lambda r: r.id)
    x, y = np.array([r.x for r in data]), np.array(["abc".index(r.label) for r in data])
    spread = x.std(0, ddof=1)
    z, w, b = x / spread, np.zeros((4, 3)), np.zeros(3)
    for _ in range(20_000):
        e = np.exp(z @ w + b - (z @ w + b).max(1, keepdims=True))
        gap = (e / e.sum(1, keepdims=True) - np.eye(3)[y]) / len(y)
        w, b = w - 0.5 * (z.T @ gap + 1e-4 * w), b - 0.5 * gap.sum(0)
    assert max(abs(np.array(p[r.id]) - e[k] / e[k].sum()).max() for k, r in enumerate(data)) < 0.02


def test_word_vectors_are_read_again_or_trained_anew(spark, tmp_path):
    df = spark.createDataFrame([(["ab", "cd", "ef"] * 4,), (["ab", "gh"] * 5,)], "tokens array<string>")
    path = str(tmp_path / "vectors")
    first = {r.token: r.vector for r in features.saved_or_trained(df, "tokens", path, 4, min_count=1, epochs=1).collect()}
    assert set(first) == {"ab", "cd", "ef", "gh"} and {len(v) for v in first.values()} == {4}
    assert {r.token: r.vector for r in features.saved_or_trained(df.limit(0), "tokens", path, 4).collect()} == first
    with pytest.warns(UserWarning, match="width"):
        again = features.saved_or_trained(df, "tokens", path, 3, min_count=1, epochs=1).collect()
    assert {len(r.vector) for r in again} == {3}
    assert [r.k for r in filters.sampled(spark.range(50).withColumnRenamed("id", "k").repartition(7), "k", 5).collect()] == [r.k for r in filters.sampled(spark.range(50).withColumnRenamed("id", "k"), "k", 5).collect()]


def test_steps_scaled_by_the_diagonal_are_fewer(monkeypatch):
    rng = np.random.default_rng(5)
    x = (rng.random((300, 40)) < np.geomspace(0.9, 0.01, 40)) * np.geomspace(30, 1, 40)
    matrix, right, taken = x.T @ x + np.eye(40), rng.normal(size=(40, 3)), []

    def product(p):
        taken.append(1)
        return matrix @ p

    plain, steps = gradients.solved(product, right, 400), len(taken)
    scaled = gradients.solved(product, right, 400, diagonal=np.diag(matrix))
    assert np.allclose(plain, np.linalg.solve(matrix, right), atol=1e-5) and np.allclose(scaled, plain, atol=1e-5) and len(taken) - steps < steps / 2
    row, place, value = np.array([0, 0, 1, 3]), np.array([2, 5, 2, 0]), np.array([1.0, 2.0, 3.0, 4.0])
    want, right = np.zeros((6, 2)), rng.normal(size=(4, 2))
    np.add.at(want, place, right[row] * value[:, None])
    for few in (0, 16):  # sorted by place, and column by column
        out = np.zeros((6, 2))
        monkeypatch.setattr(gradients, "FEW", few)
        gradients.turned((row, place, value), right, out)
        assert np.allclose(out, want)
