"""Fits whose only work over the rows is a sum: tasks add up values and gradients, the driver takes the steps.

Rows are read as a dense array column, or as sparse ones: `places` and `values` of what is not 0. A fit of many steps packs
sparse ones first (`packed`), as handing numbers to Python one by one takes longer than the sums. A sum of many numbers
goes through Spark in pages of `PAGE` numbers, which are added by page, so the driver gets one vector, whatever the number
of rows or tasks. Its length is that of the parameters, which the caller bounds by blocks of classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 1 << 13
PAGES = "page long, part binary"
#: Pages that a task hands on at a time.
TOGETHER = 16
#: Up to so many columns, sparse products are added up column by column rather than sorted by place.
FEW = 16
#: Rows of a batch that are dense at a time.
ROWS = 2048
#: Numbers of sparse rows that are packed as one row, if no single row has more.
PACK = 1 << 18


def dense(column: pa.Array) -> np.ndarray:
    """An array column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sparse(places: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and value of what is not 0."""
    count = np.diff(places.offsets.to_numpy()) if len(places) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(places)), count), places.flatten().to_numpy(zero_copy_only=False).astype(np.int64), values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def times(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a matrix of places by columns."""
    row, place, value = rows
    out = np.zeros((n, matrix.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(matrix[place] * value[:, None], first)
    return out


def turned(rows: tuple[np.ndarray, np.ndarray, np.ndarray], right: np.ndarray, out: np.ndarray) -> None:
    """Add the transposed sparse rows times a matrix of rows by columns to out, by places."""
    row, place, value = rows
    if len(row) and right.shape[1] <= FEW and len(out) <= 4 * len(row):
        for k in range(right.shape[1]):
            own = np.bincount(place, right[row, k] * value)
            out[: len(own), k] += own
    elif len(row):
        order = np.argsort(place, kind="stable")
        own = place[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[first]] += np.add.reduceat(right[row[order]] * value[order][:, None], first)


def paged(pages: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of `PAGES`, some at a time."""
    numbers = list(pages)
    for a in range(0, len(numbers), TOGETHER):
        own = numbers[a : a + TOGETHER]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([pages[k].tobytes() for k in own], pa.binary())], ["page", "part"])


def summed(rows: DataFrame, add: Callable[[np.ndarray, pa.RecordBatch], None], size: int) -> np.ndarray:
    """The sum over all rows of what add(total, batch) puts into a vector of that size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                add(total, batch.slice(a, ROWS))
                some = True
        if some:
            yield from paged({k // PAGE: total[k : k + PAGE] for k in range(0, size, PAGE) if total[k : k + PAGE].any()})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, part in zip(batch.column("page").to_pylist(), batch.column("part"), strict=True):
                own = np.frombuffer(part.as_buffer(), np.float64)
                sums[page] = sums[page] + own if page in sums else own.copy()
        yield from paged(sums)

    tasks = min(-(-size // PAGE), rows.sparkSession.sparkContext.defaultParallelism)
    pages = rows.mapInArrow(task, PAGES).repartition(max(tasks, 1), "page").mapInArrow(joined, PAGES)
    out = np.zeros(size)
    for r in pages.collect():  # one row a page of the result
        part = np.frombuffer(r.part, np.float64)
        out[r.page * PAGE : r.page * PAGE + len(part)] = part
    return out


def minimised(value_and_gradient: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 60, memory: int = 8, close: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """Limited-memory quasi-Newton steps from `start`, each shortened until the value falls enough; and the values on the way.
    Stops where the gradient has shrunk to `close` times its first length."""
    x = start.astype(float)
    value, slope = value_and_gradient(x)
    first, path, moves = max(float(np.linalg.norm(slope)), 1e-300), [value], []
    for _ in range(steps):
        if np.linalg.norm(slope) <= close * first:
            break
        way, weights = slope.copy(), []
        for s, y in reversed(moves):
            weights.append((s @ way) / (s @ y))
            way -= weights[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(float(np.linalg.norm(slope)), 1.0)
        for (s, y), w in zip(moves, reversed(weights), strict=True):
            way += s * (w - (y @ way) / (s @ y))
        rate, down = 1.0, float(way @ slope)
        for _ in range(20):
            new_value, new_slope = value_and_gradient(x - rate * way)
            if new_value <= value - 1e-4 * rate * down:
                break
            rate *= 0.4
        else:
            break  # no lower value in this direction: as near as numbers get
        s, y = -rate * way, new_slope - slope
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            moves = [*moves, (s, y)][-memory:]
        x, value, slope = x + s, new_value, new_slope
        path.append(value)
    return x, path


def solved(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int = 100, close: float = 1e-7, diagonal: np.ndarray | None = None) -> np.ndarray:
    """Conjugate gradients for a symmetric positive matrix that is known by its products only; the columns of `right` at once,
    each with steps of its own. With the matrix's diagonal rows are scaled by it, which takes fewer steps where it varies."""
    scale = 1.0 if diagonal is None else 1 / diagonal[:, None]
    x = np.zeros_like(right)
    rest = right.copy()
    way = scale * rest
    size, left = (rest * way).sum(0), (rest * rest).sum(0)
    first = np.maximum(left, 1e-300)
    for _ in range(steps):
        on = left > close * close * first
        if not on.any():
            break
        image = product(way)
        rate = np.where(on, size / np.maximum((way * image).sum(0), 1e-300), 0.0)
        x += rate * way
        rest -= rate * image
        near = scale * rest
        new = (rest * near).sum(0)
        way = near + np.where(on, new / np.maximum(size, 1e-300), 0.0) * way
        size, left = np.where(on, new, size), np.where(on, (rest * rest).sum(0), left)
    return x


class Rows:
    """A batch's features: a dense array column, or a struct of places and values."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        self.sparse = pa.types.is_struct(column.type)
        self.held = sparse(column.field("places"), column.field("values")) if self.sparse else dense(column)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        return times(self.held, self.n, matrix) if self.sparse else self.held @ matrix

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Each feature's sum and sum of squares, up to the last feature that is there."""
        if not self.sparse:
            return self.held.sum(0), (self.held**2).sum(0)
        _, place, value = self.held
        return tuple(np.bincount(place, v) for v in (value, value**2))

    def turned(self, right: np.ndarray, out: np.ndarray) -> None:
        """Add the transposed rows times `right` to out."""
        if self.sparse:
            turned(self.held, right, out)
        else:
            out += self.held.T @ right


    def add_totals(self, sums: np.ndarray, squares: np.ndarray) -> None:
        for out, own in zip((sums, squares), self.totals(), strict=True):
            out[: len(own)] += own


def packed(rows: DataFrame) -> DataFrame:
    """Sparse rows x and their codes y as bytes, about `PACK` numbers a row: how many each x has, the places that occur, and for
    each number which of these, in two bytes where that will do. Values only where they are not all 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y").to_numpy().astype(np.int32)
            row, place, value = sparse(x.field("places"), x.field("values"))
            counts = np.bincount(row, minlength=len(y)).astype(np.int32)
            ends = np.cumsum(counts, dtype=np.int64)
            a = 0
            while a < len(y):
                start = int(ends[a]) - int(counts[a])
                b = max(a + 1, int(np.searchsorted(ends, start + PACK, side="right")))
                own = slice(start, int(ends[b - 1]))
                places, at = np.unique(place[own].astype(np.int32), return_inverse=True)
                at = at.astype(np.uint16 if len(places) <= 1 << 16 else np.int32)
                values = None if (value[own] == 1).all() else value[own].tobytes()
                cells = (counts[a:b].tobytes(), y[a:b].tobytes(), places.tobytes(), at.tobytes(), values)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["counts", "y", "places", "at", "values"])
                a = b

    return rows.mapInArrow(task, "counts binary, y binary, places binary, at binary, values binary")


class Packed:
    """The sparse rows of one packed row. Products are worked out column by column, each over the places that occur."""

    sparse = True

    def __init__(self, row: dict[str, bytes | None]):
        self.counts, self.places = np.frombuffer(row["counts"], np.int32), np.frombuffer(row["places"], np.int32)
        self.n, many = len(self.counts), int(self.counts.sum(dtype=np.int64))
        self.at = np.frombuffer(row["at"], np.uint16 if len(row["at"]) == 2 * many else np.int32).astype(np.intp)
        self.values = None if row["values"] is None else np.frombuffer(row["values"], np.float64)

    def times(self, matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, matrix.shape[1]), order="F")
        there = np.flatnonzero(self.counts)
        if len(there):
            first, each = (np.cumsum(self.counts, dtype=np.int64) - self.counts)[there], np.empty(len(self.at))
            for k in range(matrix.shape[1]):
                np.take(np.take(matrix[:, k], self.places), self.at, out=each, mode="clip")
                if self.values is not None:
                    each *= self.values
                out[there, k] = np.add.reduceat(each, first)
        return out

    def turned(self, right: np.ndarray, out: np.ndarray) -> None:
        for k in range(right.shape[1]):
            each = np.repeat(right[:, k], self.counts)
            if self.values is not None:
                each *= self.values
            own = out[:, k]
            own[self.places] += np.bincount(self.at, each, len(self.places))

    def add_totals(self, sums: np.ndarray, squares: np.ndarray) -> None:
        for out, power in ((sums, 1), (squares, 2)):
            out[self.places] += np.bincount(self.at, None if self.values is None else self.values**power, len(self.places))


def parts(batch: pa.RecordBatch) -> Iterator[tuple[Rows | Packed, np.ndarray]]:
    """The features and codes of a batch, packed or not."""
    if "x" in batch.schema.names:
        yield Rows(batch.column("x")), batch.column("y").to_numpy()
        return
    for k in range(batch.num_rows):
        row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
        yield Packed(row), np.frombuffer(row["y"], np.int32)


def width(df: DataFrame, features: str) -> int:
    """How many features there are: an array's length, or one more than the last place."""
    kind = dict(df.dtypes)[features]
    size = F.array_max(F.col(f"{features}.places")) + 1 if kind.startswith("struct") else F.size(features)
    return df.agg(F.max(size).alias("n")).first().n or 0


def plain(features: str, kind: str) -> Column:
    """The features as these fits read them: doubles, whatever the array holds."""
    return F.col(features) if kind.startswith("struct") else F.transform(features, lambda v: v.cast("double"))
