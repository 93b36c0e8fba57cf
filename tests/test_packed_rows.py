"""Sparse rows that a fit's steps read again and again are packed as bytes."""

import numpy as np
import pytest

from taxolith.operators import gradients, hierarchy, models

WIDE = 90_000
SCHEMA = "k int, x struct<places: array<int>, values: array<double>>, y int"


def rows_of(ones):
    rng = np.random.default_rng(8)
    out = []
    for k, many in enumerate([3, 0, 70_000, 1, 0, 12, 40, 2]):  # one with more places than two bytes tell apart, some with none
        places = np.sort(rng.choice(WIDE, many, replace=False))
        out.append((k, {"places": places.tolist(), "values": (np.ones(many) if ones else rng.normal(size=many)).tolist()}, k % 3))
    return out


@pytest.mark.parametrize("most", [1, 50, 1 << 18])
@pytest.mark.parametrize("ones", [True, False])
def test_packed_rows_are_the_rows(spark, monkeypatch, most, ones):
    monkeypatch.setattr(gradients, "PACK", most)
    rows = rows_of(ones)
    dense = np.zeros((len(rows), WIDE))
    for k, x, _ in rows:
        dense[k, x["places"]] = x["values"]
    packed = gradients.packed(spark.createDataFrame(rows, SCHEMA).coalesce(1).select("x", "y"))
    table = packed.toArrow()
    matrix, done = np.random.default_rng(9).normal(size=(WIDE, 2)), 0
    turned, scores, sums, squares = np.zeros((2, WIDE)), np.zeros((len(rows), 2)), np.zeros(WIDE), np.zeros(WIDE)
    for batch in table.to_batches():
        for x, y in gradients.parts(batch):
            own = slice(done, done + x.n)
            assert y.tolist() == [r[2] for r in rows[own]]
            scores[own] = x.times(matrix)
            x.turned(matrix[own], turned.T)
            x.add_totals(sums, squares)
            done += x.n
    assert done == len(rows) and np.allclose(scores, dense @ matrix)
    assert np.allclose(turned, (dense.T @ matrix[: len(rows)]).T)
    assert np.allclose(sums, dense.sum(0)) and np.allclose(squares, (dense**2).sum(0))
    many = [len(x) // 4 for x in table["places"].to_pylist()]
    assert all((x is None) == ones or not n for x, n in zip(table["values"].to_pylist(), many))
    if most == 50:  # rows go together up to so many numbers, a larger one alone
        assert [len(x) // 4 for x in table["counts"].to_pylist()] == [2, 1, 3, 2]
        assert [len(x) for x in table["at"].to_pylist()] == [6, 280_000, 26, 84]


def test_steps_over_sparse_rows_read_bytes(spark):
    df = spark.createDataFrame([(k, x, "abc"[y]) for k, x, y in rows_of(True) if k != 2], SCHEMA.replace("y int", "l string"))
    own = hierarchy.Tree.fit(df, ["l"]).encode(df)
    products = models.Products(own, "x", "code_l", 3)
    try:
        assert {kind for _, kind in products.rows.dtypes} == {"binary"}
        assert products.counts.tolist() == [3, 3, 1] and products.squares == 3 + 1 + 12 + 40 + 2
    finally:
        products.rows.unpersist()


def test_a_sum_of_several_pages(spark, monkeypatch):
    monkeypatch.setattr(gradients, "PAGE", 4)
    monkeypatch.setattr(gradients, "TOGETHER", 2)

    def add(total, batch):
        for k in batch.column("id").to_pylist():
            total[k % 29] += k

    want = np.zeros(30)
    for k in range(200):
        want[k % 29] += k
    assert np.array_equal(gradients.summed(spark.range(200).repartition(5), add, 30), want)
    assert not gradients.summed(spark.range(0), add, 30).any() and gradients.summed(spark.range(9), lambda total, batch: None, 0).size == 0
