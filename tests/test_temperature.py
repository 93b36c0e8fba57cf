"""The temperature of a grid, against the SQL that goes over the whole grid."""

import math

import numpy as np
import pytest

from taxolith.operators import calibration
from taxolith.plans import recipes


def table(seed, apart):
    """Two classes in the first two of 64 dimensions."""
    label = np.arange(40) % 2
    x = np.zeros((40, 64))
    x[:, :2] = np.random.default_rng(seed).normal(size=(40, 2)).round(3) + np.where(label[:, None] == 1, [0.25, apart], [0.25, -apart])
    return [(k, x[k].tolist(), int(label[k])) for k in range(40)]


@pytest.mark.parametrize(("seed", "apart"), [(3, 0.5), (1, 1.0), (172, 2.5), (7, 2.5)])  # far above the grid, just above, below, on it
def test_the_loss_is_the_least_on_the_grid(spark, tmp_path, seed, apart):
    duckdb = pytest.importorskip("duckdb")
    rows = spark.createDataFrame(table(seed, apart), "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(recipes.ORACLES["tempered_loss"]).fetchall()
    assert [tuple(r) for r in recipes.tempered_loss(spark, str(tmp_path)).collect()] == want


def test_a_grid_is_searched_from_any_start(spark, monkeypatch):
    rng = np.random.default_rng(4)
    z, y = rng.normal(size=(60, 3)) * 4, rng.integers(3, size=60)
    z[np.arange(60), y] += 3
    df = spark.createDataFrame([(z[k].tolist(), int(y[k])) for k in range(60)] + [([0.0, 9.0, 0.0], -1)], "z array<double>, y int")
    mean = lambda t: float(np.mean(np.log(np.exp(z / t).sum(1)) - z[np.arange(60), y] / t))
    for grid in ([0.5 + 0.25 * k for k in range(40)], [0.1, 0.2], [30.0, 40.0], [1.0]):
        for start in (None, 1e-3, 1e3):  # the free fit, and fits that went wrong
            with monkeypatch.context() as m:
                if start:
                    m.setattr(calibration, "fit_temperature", lambda *a, start=start: start)
                t, loss = calibration.fit_temperature_on(df, "z", "y", grid)
            assert t == min(grid, key=mean) and math.isclose(loss, mean(t), rel_tol=1e-9)
    assert calibration.fit_temperature_on(df.where("y < 0"), "z", "y", [1.0, 2.0]) is None
