"""One network with a head a level: a hidden layer that all levels share, trained on the weighted sum of their losses.

Tasks add up the gradient of all weights over their rows; the driver holds the weights and takes quasi-Newton steps. The
first layer reads dense arrays, or what is not 0 of sparse ones, so its work goes by the rows' non-zeros."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.operators import gradients as G
from taxolith.operators.hierarchy import Tree
from taxolith.operators.models import LevelModels, by_arrow


@dataclass
class Network:
    first: np.ndarray  # features + 1 by hidden; the last row is added whatever the features
    heads: list[np.ndarray]  # hidden + 1 by classes
    path: list[float] = field(default_factory=list)  # the loss, step by step

    @staticmethod
    def fresh(features: int, hidden: int, classes: Sequence[int], seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: np.concatenate([rng.standard_normal((a, b)) * (2 / max(a, 1)) ** 0.5, np.zeros((1, b))])
        return Network(draw(features, hidden), [draw(hidden, n) for n in classes])

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in (self.first, *self.heads)])

    def shaped(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for w in (self.first, *self.heads):
            out.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        return Network(out[0], out[1:])

    def hidden(self, x: G.Rows) -> np.ndarray:
        return np.maximum(x.times(self.first[:-1]) + self.first[-1], 0)

    def probabilities(self, x: G.Rows, level: int) -> np.ndarray:
        z = self.hidden(x) @ self.heads[level][:-1] + self.heads[level][-1]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def loss(self, x: G.Rows, codes: np.ndarray, weights: Sequence[float], out: np.ndarray | None = None) -> float:
        """The weighted losses, summed over the rows; codes: rows by levels, below 0 if unknown. The gradient is added to out."""
        h = self.hidden(x)
        back, total = np.zeros_like(h), 0.0
        grad = self.shaped(out) if out is not None else None
        for k, (head, weight) in enumerate(zip(self.heads, weights, strict=True)):
            on = np.flatnonzero(codes[:, k] >= 0)
            p, y = self.probabilities(x, k)[on], codes[on, k]
            total -= weight * float(np.log(np.maximum(p[np.arange(len(on)), y], 1e-300)).sum())
            if grad is not None:
                p[np.arange(len(on)), y] -= 1
                p *= weight
                grad.heads[k][:-1] += h[on].T @ p
                grad.heads[k][-1] += p.sum(0)
                back[on] += p @ head[:-1].T
        if grad is not None:
            back *= h > 0
            x.turned(back, grad.first[:-1])
            grad.first[-1] += back.sum(0)
        return total


@dataclass
class Head:
    """One level of a network, as a model of that level."""

    network: Network
    level: int

    @property
    def path(self) -> list[float]:
        return self.network.path

    def probabilities(self, features: str) -> Column:
        network, level = self.network, self.level
        return by_arrow(features, lambda x: network.probabilities(x, level))


def fit_network(df: DataFrame, tree: Tree, features: str, hidden: int = 64, weights: Sequence[float] | None = None, penalty: float = 1e-4, steps: int = 60, seed: int = 0) -> LevelModels:
    """All levels' heads on one hidden layer. weights: what each level's mean loss counts; penalty: on the squared weights.
    A step's sums are features * hidden + hidden * classes numbers, which the driver holds a few times over."""
    levels = len(tree.levels)
    weights = list(weights) if weights is not None else [1.0] * levels
    if len(weights) != levels:
        raise ValueError(f"{len(weights)} weights for {levels} levels")
    own = tree.encode(df)
    rows = own.select(G.plain(features, dict(df.dtypes)[features]).alias("x"), *[F.col(f"code_{c}").cast("int").alias(f"y{k}") for k, c in enumerate(tree.levels)]).where(F.greatest(*[F.col(f"y{k}") for k in range(levels)], F.lit(-1)) >= 0).persist()
    try:
        counts = rows.agg(*[F.count_if(F.col(f"y{k}") >= 0).alias(f"n{k}") for k in range(levels)]).first()
        share = [w / max(n, 1) for w, n in zip(weights, counts, strict=True)]
        start = Network.fresh(G.width(rows, "x"), hidden, tree.sizes, seed)

        def value(flat: np.ndarray) -> tuple[float, np.ndarray]:
            net = start.shaped(flat)

            def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
                codes = np.stack([batch.column(f"y{k}").to_numpy() for k in range(levels)], 1)
                total[0] += net.loss(G.Rows(batch.column("x")), codes, share, total[1:])

            got = G.summed(rows, add, 1 + flat.size)
            return got[0] + 0.5 * penalty * float(flat @ flat), got[1:] + penalty * flat

        best, path = G.minimised(value, start.flat(), steps)
    finally:
        rows.unpersist()
    net = start.shaped(best)
    net.path = path
    return LevelModels(tree, [Head(net, k) for k in range(levels)])
