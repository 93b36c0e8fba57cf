"""One classifier a tree level, all with the same output: an array of class probabilities a level.

Rows stay in Spark: MLlib fits what it has; the closed forms (centroids, LDA, ridge) need sums over rows, which tasks
add up first, and matrices of features by features, which are solved on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.operators import gradients as G
from taxolith.operators.hierarchy import Tree

VECTOR = "_vector"
#: Weights that a fit holds at a time.
NUMBERS = 4_000_000
#: Up to so many weights are constants of a plan; more go to the tasks' Arrow batches.
LITERALS = 20_000
#: Up to so many features a closed form reads their matrix of products; beyond, steps read the rows.
WIDE = 1024


def by_arrow(features: str, run: Callable[[G.Rows], np.ndarray]) -> Column:
    """An array of numbers a row from batches of features, dense or sparse."""

    def task(x: pa.Array) -> pa.Array:
        out = np.ascontiguousarray(run(G.Rows(x)), float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

    return F.arrow_udf(task, "array<double>")(features)


@dataclass(frozen=True)
class Linear:
    """Class scores as a linear map of the features, softmax over scores / temperature."""

    weights: tuple[tuple[float, ...], ...]  # by class
    bias: tuple[float, ...]
    temperature: float = 1.0
    sparse: bool = False  # features are structs of places and values

    def margins(self, features: str) -> Column:
        if self.sparse or len(self.bias) * len(self.weights[0]) > LITERALS:
            weights, bias = np.array(self.weights).T, np.array(self.bias)
            return by_arrow(features, lambda x: x.times(weights) + bias)

        def scores(x: Column) -> Column:
            return F.transform(F.lit([list(w) for w in self.weights]), lambda w: A.total(F.zip_with(w, x, lambda a, b: a * b)))

        own = A.bind(F.transform(features, lambda v: v.cast("double")), scores)
        return F.zip_with(own, F.lit(list(self.bias)), lambda a, b: a + b)

    def probabilities(self, features: str) -> Column:
        return A.softmax(self.margins(features), self.temperature)


@dataclass(frozen=True)
class Centroids:
    """Softmax of the similarity to each class mean over a temperature. metric: cosine, or euclidean (minus the square)."""

    means: tuple[tuple[float, ...], ...]
    metric: str = "cosine"
    temperature: float = 0.1

    def margins(self, features: str) -> Column:
        table = F.lit([list(m) for m in self.means])
        norms = F.lit([float(np.linalg.norm(m)) for m in self.means])

        def cosine(x: Column) -> Column:
            def sized(size: Column) -> Column:
                dots = F.transform(table, lambda m: A.total(F.zip_with(m, x, lambda a, b: a * b)))
                return F.zip_with(dots, norms, lambda d, n: F.when((n > 0) & (size > 0), d / (n * size)).otherwise(0.0))

            return A.bind(F.sqrt(A.total(F.transform(x, lambda v: v * v))), sized)

        def euclidean(x: Column) -> Column:
            return F.transform(table, lambda m: -A.total(F.zip_with(m, x, lambda a, b: (a - b) * (a - b))))

        return A.bind(F.transform(features, lambda v: v.cast("double")), cosine if self.metric == "cosine" else euclidean)

    def probabilities(self, features: str) -> Column:
        return A.softmax(self.margins(features), self.temperature)


def class_means(df: DataFrame, features: str, code: str) -> DataFrame:
    """code, n, mean: by partial sums of (class, place) cells, whatever the number of places."""
    return means_by(df.where(F.col(code) >= 0).withColumnRenamed(code, "code"), ["code"], features)


def means_by(df: DataFrame, keys: Sequence[str], features: str) -> DataFrame:
    """The keys, n and mean of an array column."""
    cells = df.select(*keys, F.posexplode(features).alias("_k", "_x")).groupBy(*keys, "_k").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_m"))), lambda x: x["_m"])
    return cells.groupBy(*keys).agg(F.max("_n").alias("n"), mean.alias("mean"))


def moments(df: DataFrame, features: str, code: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by class, sums by class, the matrix of products (features x features), and the classes present.

    A task sends its sums as numbered cells, which Spark adds up; the driver gets features * (features + classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums, counts = None, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("x").to_pylist(), float)
            y = batch.column("y").to_numpy()
            gram = x.T @ x + (0 if gram is None else gram)
            for c in np.unique(y).tolist():
                sums[c] = sums.get(c, 0) + x[y == c].sum(0)
                counts[c] = counts.get(c, 0) + int((y == c).sum())
        if gram is not None:
            d = len(gram)
            i, j = np.divmod(np.arange(d * d), d)
            rows = [(np.full(d * d, -1), i, j, gram.ravel())]
            for c in sums:
                rows.append((np.full(d + 1, c), np.full(d + 1, -1), np.arange(d + 1), np.append(sums[c], counts[c])))
            cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in cols[:3]), pa.array(cols[3].astype(float))], ["c", "i", "j", "v"])

    rows = df.where(F.col(code) >= 0).select(F.transform(features, lambda v: v.cast("double")).alias("x"), F.col(code).cast("int").alias("y"))
    cells = rows.mapInArrow(run, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect()
    d = max((r.j for r in cells), default=-1)
    gram = np.zeros((d, d))
    codes = sorted({r.c for r in cells if r.c >= 0})
    place = {c: k for k, c in enumerate(codes)}
    sums, counts = np.zeros((len(codes), d)), np.zeros(len(codes))
    for r in cells:
        if r.c < 0:
            gram[r.i, r.j] = r.v
        elif r.j == d:
            counts[place[r.c]] = r.v
        else:
            sums[place[r.c], r.j] = r.v
    return counts, sums, gram, np.array(codes)


def fit_centroids(df: DataFrame, features: str, code: str, n: int, metric: str = "cosine", temperature: float = 0.1) -> Centroids:
    found = {r.code: r.mean for r in class_means(df, features, code).collect()}  # one row a class
    width = len(next(iter(found.values()), []))
    return Centroids(tuple(tuple(found.get(k, [0.0] * width)) for k in range(n)), metric, temperature)


def ledoit_wolf(df: DataFrame, features: str, code: str, means: np.ndarray, codes: np.ndarray, cov: np.ndarray, rows: float) -> float:
    """The share of the identity that Ledoit and Wolf's rule gives a covariance within classes: a second pass sums the
    fourth powers of the rows' distances from their class means."""
    table = F.lit([list(map(float, means[np.flatnonzero(codes == k)[0]])) if k in codes else [0.0] * means.shape[1] for k in range(int(codes.max()) + 1)])
    distance = A.total(F.zip_with(F.transform(features, lambda v: v.cast("double")), F.get(table, F.col(code).cast("int")), lambda x, m: (x - m) * (x - m)))
    fourth = df.where(F.col(code) >= 0).agg(F.sum(distance * distance).alias("b")).first().b
    d = len(cov)
    spread = float((cov**2).sum())
    delta = (spread - np.trace(cov) ** 2 / d) / d
    beta = (fourth / rows - spread) / (d * rows)
    return float(min(max(beta, 0.0), delta) / delta) if delta > 0 else 0.0


def fit_lda(df: DataFrame, features: str, code: str, n: int, shrinkage: float | None = None) -> Linear:
    """One covariance for all classes, drawn towards a multiple of the identity: by the share given, or Ledoit-Wolf's. Sparse
    or many features need a share: their covariance is known by its products only."""
    if wide(df, features):
        if shrinkage is None:
            raise ValueError("sparse or many features need a given shrinkage")
        return Products(df, features, code, n).discriminants(shrinkage)
    counts, sums, gram, codes = moments(df, features, code)
    means = sums / counts[:, None]
    cov = (gram - (sums.T / counts) @ sums) / max(counts.sum(), 1)
    d = len(cov)
    if shrinkage is None:
        shrinkage = ledoit_wolf(df, features, code, means, codes, cov, counts.sum())
    cov = (1 - shrinkage) * cov + shrinkage * np.trace(cov) / d * np.eye(d)
    w = np.linalg.solve(cov, means.T).T
    b = -0.5 * (w * means).sum(1) + np.log(counts / counts.sum())
    weights, bias = np.zeros((n, d)), np.full(n, -60.0)
    weights[codes], bias[codes] = w, b
    return Linear(tuple(map(tuple, weights.tolist())), tuple(bias.tolist()))


def fit_ridge(df: DataFrame, features: str, code: str, n: int, alpha: float = 1.0, temperature: float = 1.0) -> Linear:
    """Least squares on class indicators with a penalty; softmax of the margins."""
    if wide(df, features):
        return Products(df, features, code, n).ridge(alpha, temperature)
    counts, sums, gram, codes = moments(df, features, code)
    total, d = counts.sum(), gram.shape[0]
    mean = sums.sum(0) / total
    centred = gram - total * np.outer(mean, mean)
    target = np.zeros((d, n))
    target[:, codes] = (sums - counts[:, None] * mean).T
    w = np.linalg.solve(centred + alpha * np.eye(d), target)
    share = np.zeros(n)
    share[codes] = counts / total
    return Linear(tuple(map(tuple, w.T.tolist())), tuple((share - mean @ w).tolist()), temperature)


def wide(df: DataFrame, features: str) -> bool:
    return dict(df.dtypes)[features].startswith("struct") or G.width(df, features) > WIDE


class Products:
    """Rows whose matrix of products is only ever multiplied: each step of conjugate gradients is one pass, in which tasks
    add up features x classes numbers. Classes go in blocks of about `NUMBERS` of them."""

    def __init__(self, df: DataFrame, features: str, code: str, n: int):
        rows = df.where(F.col(code) >= 0).select(G.plain(features, dict(df.dtypes)[features]).alias("x"), F.col(code).cast("int").alias("y"))
        self.d, self.n, self.sparse = G.width(df, features), n, dict(df.dtypes)[features].startswith("struct")
        rows = G.packed(rows) if self.sparse else rows
        self.rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()  # a task gives a whole sum, so one a core
        d = self.d

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            for x, y in G.parts(batch):
                x.add_totals(total[:d], total[d : 2 * d])
                total[2 * d :] += np.bincount(y, minlength=n)

        got = G.summed(self.rows, add, 2 * d + n)
        self.counts = got[2 * d :]
        self.total = self.counts.sum()
        if not self.total:
            self.rows.unpersist()
            raise ValueError("no rows to learn from")
        self.mean = got[:d] / self.total
        self.squares = got[d : 2 * d].sum()
        self.diagonal = np.maximum(got[d : 2 * d] - self.total * self.mean**2, 0.0)  # of the centred products

    def blocks(self) -> Iterator[np.ndarray]:
        many = max(1, NUMBERS // max(self.d, 1))
        for start in range(0, self.n, many):
            yield np.arange(start, min(self.n, start + many))

    def sums(self, classes: np.ndarray) -> np.ndarray:
        """Features x classes: the sums over each class's rows."""
        shape = len(classes), self.d

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            for x, y in G.parts(batch):
                x.turned((y[:, None] == classes).astype(float), total.reshape(shape).T)

        return G.summed(self.rows, add, self.d * len(classes)).reshape(shape).T

    def centred(self, p: np.ndarray) -> np.ndarray:
        """The products of the features, their means taken out, times p."""

        columns, shape = np.asfortranarray(p), p.shape[::-1]

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            for x, _ in G.parts(batch):
                x.turned(x.times(columns), total.reshape(shape).T)

        return G.summed(self.rows, add, p.size).reshape(shape).T - self.total * np.outer(self.mean, self.mean @ p)

    def ridge(self, alpha: float, temperature: float) -> Linear:
        weights, bias = np.zeros((self.d, self.n)), np.zeros(self.n)
        try:
            for own in self.blocks():
                right = self.sums(own) - np.outer(self.mean, self.counts[own])
                weights[:, own] = G.solved(lambda p: self.centred(p) + alpha * p, right, diagonal=self.diagonal + alpha if alpha > 0 else None)
        finally:
            self.rows.unpersist()
        bias = self.counts / self.total - self.mean @ weights
        return Linear(tuple(map(tuple, weights.T.tolist())), tuple(bias.tolist()), temperature, self.sparse)

    def discriminants(self, shrinkage: float) -> Linear:
        weights, bias = np.zeros((self.n, self.d)), np.full(self.n, -60.0)
        try:
            there = np.flatnonzero(self.counts)
            means = np.concatenate([self.sums(own) for own in self.blocks()], 1)[:, there] / self.counts[there]
            among = means * np.sqrt(self.counts[there])
            trace = (self.squares - (among**2).sum()) / self.total

            def within(p: np.ndarray) -> np.ndarray:
                cov = (self.centred(p) + self.total * np.outer(self.mean, self.mean @ p) - among @ (among.T @ p)) / self.total
                return (1 - shrinkage) * cov + shrinkage * trace / self.d * p

            many = max(1, NUMBERS // max(self.d, 1))
            w = np.concatenate([G.solved(within, means[:, a : a + many]) for a in range(0, len(there), many)], 1)
        finally:
            self.rows.unpersist()
        weights[there] = w.T
        bias[there] = -0.5 * (w * means).sum(0) + np.log(self.counts[there] / self.total)
        return Linear(tuple(map(tuple, weights.tolist())), tuple(bias.tolist()), 1.0, self.sparse)


@dataclass(frozen=True)
class PlattMargins:
    """One-vs-rest margins of several fits, each through its own logistic curves; their mean, made to sum to 1."""

    fits: tuple[tuple[tuple[tuple[float, ...], ...], tuple[float, ...], tuple[float, ...], tuple[float, ...]], ...]  # weights, bias, slopes, intercepts
    sparse: bool = False

    def probabilities(self, features: str) -> Column:
        def shares(fit: tuple) -> Column:
            weights, bias, slopes, intercepts = fit
            curve = lambda m: F.transform(m, lambda x, i: 1 / (1 + F.exp(-(x * F.get(F.lit(list(slopes)), i) + F.get(F.lit(list(intercepts)), i)))))
            return A.bind(Linear(weights, bias, 1.0, self.sparse).margins(features), curve)

        sums = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), map(shares, self.fits))
        return A.bind(sums, lambda s: A.bind(F.greatest(A.total(s), F.lit(A.FLOOR)), lambda t: F.transform(s, lambda x: x / t)))


def fit_svc(df: DataFrame, features: str, code: str, n: int, folds: int = 3, cost: float = 1.0, fold: str | None = None, steps: int = 60) -> PlattMargins:
    """Linear support vectors, each class against the rest, with the squared hinge loss; in each fold, curves are fitted to
    the margins of the rows that its weights have not seen. Rows are dealt to folds by a hash of their features, or by the
    column `fold`.

    All classes and folds are one fit: a step is one pass, in which tasks add up the gradient of all their weights. Classes
    go in blocks of about `NUMBERS` weights, which bounds what the driver and a task hold."""
    x = G.plain(features, dict(df.dtypes)[features])
    dealt = F.col(fold).cast("int") if fold else F.pmod(F.xxhash64(x), F.lit(folds)).cast("int")
    rows = df.where(F.col(code) >= 0).select(x.alias("x"), F.col(code).cast("int").alias("y"), dealt.alias("f")).persist()
    try:
        counts = {r.f: r.n for r in rows.groupBy("f").agg(F.count("*").alias("n")).collect()}  # one row a fold
        total, d = sum(counts.values()), G.width(rows, "x")
        if not total:
            raise ValueError("no rows to learn from")
        weigh = np.array([1 / max(total - counts.get(f, 0), 1) for f in range(folds)])
        weights, curves = np.zeros((folds, n, d + 1)), np.zeros((folds, n, 2))
        many = max(1, NUMBERS // (folds * (d + 1)))
        for start in range(0, n, many):
            own = np.arange(start, min(n, start + many))
            shape = (d + 1, folds, len(own))
            value = lambda w: _hinge(rows, w.reshape(shape), own, weigh, cost)  # noqa: B023, E731
            best, _ = G.minimised(value, np.zeros(np.prod(shape)), steps)
            best = best.reshape(shape)
            weights[:, own] = best.transpose(1, 2, 0)
            curves[:, own] = platt_curves(rows, best, own)
    finally:
        rows.unpersist()
    part = lambda a: tuple(map(tuple, a.tolist()))
    return PlattMargins(tuple((part(w[:, :-1]), tuple(w[:, -1].tolist()), tuple(c[:, 0].tolist()), tuple(c[:, 1].tolist())) for w, c in zip(weights, curves, strict=True)), dict(df.dtypes)[features].startswith("struct"))


def _margins(batch: pa.RecordBatch, w: np.ndarray) -> tuple[G.Rows, np.ndarray]:
    """The rows' features, and their margins by fold and class."""
    x = G.Rows(batch.column("x"))
    return x, (x.times(w[:-1].reshape(len(w) - 1, -1)) + w[-1].ravel()).reshape(x.n, *w.shape[1:])


def _hinge(rows: DataFrame, w: np.ndarray, classes: np.ndarray, weigh: np.ndarray, cost: float) -> tuple[float, np.ndarray]:
    """The loss of every class and fold and its gradient: the mean squared hinge over the other folds' rows, and the squared
    weights over twice cost * rows."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        x, m = _margins(batch, w)
        side = np.where(batch.column("y").to_numpy()[:, None] == classes, 1.0, -1.0)[:, None, :]
        use = (batch.column("f").to_numpy()[:, None] != np.arange(len(weigh))) * weigh
        short = np.maximum(1 - side * m, 0) * use[:, :, None]
        total[0] += float((np.maximum(1 - side * m, 0) * short).sum())
        right = (-2 * side * short).reshape(x.n, -1)
        out = total[1:].reshape(len(w), -1)
        x.turned(right, out[:-1])
        out[-1] += right.sum(0)

    got = G.summed(rows, add, 1 + w.size)
    held = w * (weigh / cost)[:, None]
    return got[0] + 0.5 * float((w * held).sum()), got[1:] + held.ravel()


def platt_curves(rows: DataFrame, w: np.ndarray, classes: np.ndarray, steps: int = 12) -> np.ndarray:
    """Slope and intercept, by fold and class, of the logistic curves from the margins of the fold's own rows, by Newton steps
    for all of them at once: each is one pass. Targets are drawn in by Platt's rule, so classes that margins part fully have
    finite curves. A slope is never negative: margins that don't rank the held-out rows get a level curve."""
    shape = w.shape[1:]

    def over(f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int) -> np.ndarray:
        """Sums of k numbers by fold and class: f(margin, hit, 1 for the fold's own rows)."""

        def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
            _, m = _margins(batch, w)
            hit = np.broadcast_to((batch.column("y").to_numpy()[:, None] == classes)[:, None, :], m.shape)
            own = (batch.column("f").to_numpy()[:, None] == np.arange(shape[0]))[:, :, None]
            total += (f(m, hit, own)).sum(1).ravel()

        return G.summed(rows, add, k * shape[0] * shape[1]).reshape(k, *shape)

    hits, count = over(lambda m, hit, own: np.stack([hit * own, own * np.ones_like(m)]), 2)
    high, low = (hits + 1) / (hits + 2), 1 / (count - hits + 2)
    level = np.where(count > 0, (hits * high + (count - hits) * low) / np.maximum(count, 1), 0.5)
    a, b = np.zeros(shape), np.log(level / (1 - level))
    for _ in range(steps):
        def parts(m: np.ndarray, hit: np.ndarray, own: np.ndarray, a: np.ndarray = a, b: np.ndarray = b) -> np.ndarray:
            p = 1 / (1 + np.exp(-np.clip(m * a + b, -40, 40)))
            gap, bend = (np.where(hit, high, low) - p) * own, np.maximum(p * (1 - p), 1e-12) * own
            return np.stack([gap * m, gap, bend * m * m, bend * m, bend])

        ga, gb, haa, hab, hbb = over(parts, 5)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = np.maximum(haa * hbb - hab * hab, 1e-18)
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = np.minimum(1.0, 4.0 / np.maximum(np.maximum(abs(da), abs(db)), 1e-12))
        a, b = a + scale * da, b + scale * db
        if max(abs(da).max(), abs(db).max()) < 1e-9:
            break
    level = np.log(level / (1 - level))
    return np.stack([np.maximum(a, 0), np.where(a < 0, level, b)], -1)


def _mllib(make: Callable[[], object]) -> Callable:
    def fit(df: DataFrame, features: str, code: str, n: int) -> Model:
        kind = dict(df.dtypes)[features]
        column = array_to_vector(F.col(features).cast("array<double>")) if kind.startswith("array") else F.col(features)
        rows = df.where(F.col(code) >= 0).select(column.alias(VECTOR), F.col(code).cast("double").alias("label"))
        return make().setFeaturesCol(VECTOR).setLabelCol("label").fit(rows)

    return fit


def _perceptron(df: DataFrame, features: str, code: str, n: int) -> Model:
    width = df.select(F.size(features).alias("w")).first().w
    return _mllib(lambda: MultilayerPerceptronClassifier(layers=[width, 64, 32, n], maxIter=60, seed=7))(df, features, code, n)


#: name -> (fit(df, features, code, n classes), what it costs)
REGISTRY: dict[str, tuple[Callable, str]] = {
    "centroid": (fit_centroids, "one aggregation"),
    "lda": (fit_lda, "one aggregation, one solve of features x features; steps over the rows for many features"),
    "ridge": (fit_ridge, "one aggregation, one solve of features x features; steps over the rows for many features"),
    "gaussian_nb": (_mllib(lambda: NaiveBayes(modelType="gaussian")), "one aggregation"),
    "multinomial_nb": (_mllib(lambda: NaiveBayes(modelType="multinomial")), "one aggregation, sparse; for thousands of classes"),
    "bernoulli_nb": (_mllib(lambda: NaiveBayes(modelType="bernoulli")), "one aggregation, sparse, binary features"),
    "logistic": (_mllib(lambda: LogisticRegression(family="multinomial", maxIter=50, regParam=1e-4)), "iterations; classes x features weights"),
    "logistic_one_vs_rest": (_mllib(lambda: OneVsRest(classifier=LogisticRegression(maxIter=50, regParam=1e-4))), "a fit a class"),
    "linear_svc": (fit_svc, "steps over all classes and folds at once"),
    "perceptron": (_perceptron, "iterations over dense vectors"),
}


def register(name: str, fit: Callable, cost: str = "") -> None:
    """Add a model of one's own: fit(df, features, code, n classes) gives an object with probabilities(features) -> Column,
    or an MLlib model."""
    REGISTRY[name] = (fit, cost)


def describe() -> list[tuple[str, str]]:
    return [(name, cost) for name, (_, cost) in REGISTRY.items()]


def fitter(name: str) -> Callable:
    if name not in REGISTRY:
        raise KeyError(f"no model {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name][0]


@dataclass
class LevelModels:
    tree: Tree
    models: list

    def probabilities(self, df: DataFrame, features: str, logits: bool = False) -> tuple[DataFrame, list[str]]:
        """df with an array column p_<level> of class probabilities for each level; with logits also logits_<level>, what
        the probabilities are the softmax of, for calibration (MLlib's raw predictions; logs where a model has none)."""
        names = [f"p_{c}" for c in self.tree.levels]
        for name, model, n in zip(names, self.models, self.tree.sizes, strict=True):
            raw = f"logits_{name[2:]}"
            if hasattr(model, "probabilities"):
                df = df.withColumn(name, model.probabilities(features))
                if logits:
                    df = df.withColumn(raw, F.transform(model.margins(features), lambda x: x / model.temperature) if hasattr(model, "margins") else F.transform(name, lambda x: F.log(F.greatest(x, F.lit(A.FLOOR)))))
                continue
            column = array_to_vector(F.col(features).cast("array<double>")) if dict(df.dtypes)[features].startswith("array") else F.col(features)
            kept = df.columns
            out = model.transform(df.withColumn(VECTOR, column))
            if "probability" in out.columns:
                p = vector_to_array("probability")
            else:  # one-vs-rest has raw margins only: their logistic, made to sum to 1
                p = A.softmax(F.transform(vector_to_array("rawPrediction"), lambda x: 2 * x))
            own = [F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _padded(p)).alias(name)]
            if logits:
                own.append(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), _padded(vector_to_array("rawPrediction"), -60.0)).alias(raw))
            df = out.select(*kept, *own)
        return df, names


def _padded(p: Column, rest: float = 0.0) -> Callable[[Column], Column]:
    return lambda i: F.coalesce(F.get(p, i), F.lit(rest))


def history(models: LevelModels, spark: SparkSession) -> DataFrame:
    """level, step, objective: how the fit of each level went, for models that are fitted in steps."""
    rows = []
    for level, model in zip(models.tree.levels, models.models, strict=True):
        if hasattr(model, "path"):  # of all levels at once
            rows += [(level, k, float(x)) for k, x in enumerate(model.path)]
        elif getattr(model, "hasSummary", False):
            own = model.summary() if callable(model.summary) else model.summary
            rows += [(level, k, float(x)) for k, x in enumerate(own.objectiveHistory)]
    return spark.createDataFrame(rows, "level string, step int, objective double")


def fit_levels(df: DataFrame, tree: Tree, features: str, name: str | Callable = "centroid", **how) -> LevelModels:
    """One model a level on the rows whose label the tree has. name: of the registry, or a factory with its signature."""
    own, fit = tree.encode(df), fitter(name) if isinstance(name, str) else name
    return LevelModels(tree, [fit(own, features, f"code_{c}", n, **how) for c, n in zip(tree.levels, tree.sizes, strict=True)])


def platt(df: DataFrame, margin: str, correct: Column) -> Mapping[str, float]:
    """Slope and intercept of a logistic curve from margins to the chance of being right."""
    rows = df.select(array_to_vector(F.array(F.col(margin).cast("double"))).alias(VECTOR), correct.cast("double").alias("label"))
    model = LogisticRegression(featuresCol=VECTOR, labelCol="label").fit(rows)
    return {"slope": float(model.coefficients[0]), "intercept": float(model.intercept)}


def with_platt(margin: Column, curve: Mapping[str, float]) -> Column:
    return 1 / (1 + F.exp(-(margin * curve["slope"] + curve["intercept"])))


def per_parent(df: DataFrame, parent: str, features: str, label: str) -> DataFrame:
    """parent, label, mean, n: a model for the children of each parent, as class means by aggregation: a hot parent is
    summed in the tasks like any other."""
    return means_by(df, [parent, label], features)


def check_levels(models: Sequence[LevelModels]) -> None:
    if any(m.tree.classes != models[0].tree.classes for m in models):
        raise ValueError("the models' trees differ")
