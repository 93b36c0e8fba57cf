"""Row-wise arithmetic on arrays of numbers: what scoring a row needs without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once: within a lambda, a plain expression would be worked out again for every element."""
    return F.get(F.transform(F.array(x), f), 0)


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))


def softmax(c: Column, temperature: float = 1.0) -> Column:
    def shifted(z: Column) -> Column:
        return bind(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp((x.cast("double") - m) / temperature)))

    return bind(bind(c, shifted), lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_sum_exp(c: Column) -> Column:
    return bind(c, lambda z: bind(F.array_max(z), lambda m: m + F.log(total(F.transform(z, lambda x: F.exp(x - m))))))


def arg_max(c: Column) -> Column:
    """The first place of the largest value, from 0."""
    return bind(c, lambda z: F.array_position(z, F.array_max(z)).cast("int") - 1)


def second(c: Column) -> Column:
    """The second largest value; 0 if there is only one."""
    return F.coalesce(F.get(F.reverse(F.array_sort(c)), 1), F.lit(0.0))


def margin(c: Column) -> Column:
    return bind(c, lambda z: F.array_max(z) - second(z))


def entropy(c: Column) -> Column:
    """In nats, each share at least FLOOR."""
    return -F.aggregate(c, F.lit(0.0), lambda a, x: a + F.greatest(x.cast("double"), F.lit(FLOOR)) * F.log(F.greatest(x.cast("double"), F.lit(FLOOR))))


def top_places(c: Column, k: int) -> Column:
    """array<struct<value, place>> of the k largest values, ties by place."""
    ordered = F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("minus"), i.alias("place"))))
    return F.transform(F.slice(ordered, 1, k), lambda x: F.struct((-x["minus"]).alias("value"), x["place"].alias("place")))


def rank_of(c: Column, place: Column) -> Column:
    """How many values are larger than that at the place, and equal ones before it; null if the place is below 0."""
    return F.when(place >= 0, bind(F.struct(c.alias("c"), F.get(c, place).alias("own"), place.alias("p")), lambda v: F.size(F.filter(v["c"], lambda x, i: (x > v["own"]) | ((x == v["own"]) & (i < v["p"]))))))


def mean_of(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def widened(c: Column, places: list[int], width: int) -> Column:
    """Shares of some classes as shares of all: the k-th value goes to places[k], the rest is 0."""
    at = {p: k for k, p in enumerate(places)}
    return F.array(*[F.get(c, at[w]) if w in at else F.lit(0.0) for w in range(width)])
