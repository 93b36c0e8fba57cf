"""Tokens and n-grams of a text, as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxolith.functions.arrays import bind

TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokenize(c: Column, lower: bool = True) -> Column:
    """Maximal runs of two or more word characters; null has none."""
    c = F.coalesce(c, F.lit(""))
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(TOKEN), F.lit(0))


def ngrams(tokens: Column, low: int = 1, high: int = 1, fold: bool = False) -> Column:
    """All n-grams for low <= n <= high, words joined by a space; with fold, the two words of a bigram are in order."""
    def all_of(t: Column) -> Column:
        parts = [pairs(t) if fold and n == 2 else longer(t, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def longer(t: Column, n: int) -> Column:
        """Each shorter n-gram with the token after it."""
        if n == 1:
            return t
        count = F.greatest(F.size(t) - (n - 1), F.lit(0))
        return F.zip_with(F.slice(longer(t, n - 1), F.lit(1), count), F.slice(t, F.lit(n), count), lambda a, b: F.concat(a, F.lit(" "), b))

    def pairs(t: Column) -> Column:
        count = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, F.lit(1), count), F.slice(t, F.lit(2), count), lambda a, b: F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b)))

    return bind(tokens, all_of)


def counted(grams: Column, binary: bool = False) -> Column:
    """array<struct<feature, tf>>: each gram once, with how often it is there (binary: 1)."""
    if binary:
        return F.transform(F.array_distinct(grams), lambda g: F.struct(g.alias("feature"), F.lit(1).cast("long").alias("tf")))

    def runs(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return bind(first, lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), F.array(F.size(s))), lambda i, j: F.struct(F.get(s, i).alias("feature"), (j - i).cast("long").alias("tf"))))

    none = F.expr("cast(array() as array<struct<feature: string, tf: bigint>>)")
    return bind(F.sort_array(grams), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def folded(grams: Column) -> Column:
    """Bigrams with their halves in order; other n-grams as they are."""
    return F.transform(grams, lambda g: F.when(F.size(F.split(g, " ")) == 2, F.array_join(F.array_sort(F.split(g, " ")), " ")).otherwise(g))
