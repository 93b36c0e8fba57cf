"""The label tree, and scores over the paths that exist.

A tree is small (its paths are distinct label tuples), so it lives on the driver as tables of codes; rows never do.
All scoring is row by row over the tree's constant arrays: no shuffle, so it runs on streams as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions import arrays as A


@dataclass(frozen=True)
class Tree:
    levels: tuple[str, ...]
    classes: tuple[tuple[str, ...], ...]  # by level, sorted
    paths: tuple[tuple[int, ...], ...]  # codes by level, sorted
    counts: tuple[int, ...]

    @staticmethod
    def fit(df: DataFrame, levels: Sequence[str]) -> Tree:
        rows = df.select(*[F.col(c).cast("string").alias(c) for c in levels]).dropna().groupBy(*levels).count().collect()  # one row a path
        classes = tuple(tuple(sorted({r[c] for r in rows})) for c in levels)
        code = [{x: k for k, x in enumerate(own)} for own in classes]
        found = sorted((tuple(code[k][r[c]] for k, c in enumerate(levels)), r["count"]) for r in rows)
        return Tree(tuple(levels), classes, tuple(p for p, _ in found), tuple(n for _, n in found))

    @property
    def sizes(self) -> list[int]:
        return [len(c) for c in self.classes]

    def record(self) -> str:
        return json.dumps({"levels": self.levels, "classes": self.classes, "paths": self.paths, "counts": self.counts})

    @staticmethod
    def of_record(text: str) -> Tree:
        x = json.loads(text)
        return Tree(tuple(x["levels"]), tuple(map(tuple, x["classes"])), tuple(map(tuple, x["paths"])), tuple(x["counts"]))

    @cached_property
    def prefixes(self) -> list[list[tuple[int, ...]]]:
        """By depth from 0: the distinct prefixes of that many codes, sorted."""
        return [sorted({p[:d] for p in self.paths}) for d in range(len(self.levels) + 1)]

    def prefix_of_path(self, depth: int) -> list[int]:
        number = {p: k for k, p in enumerate(self.prefixes[depth])}
        return [number[p[:depth]] for p in self.paths]

    def members(self, depth: int) -> list[list[int]]:
        """The paths under each prefix."""
        out: list[list[int]] = [[] for _ in self.prefixes[depth]]
        for k, g in enumerate(self.prefix_of_path(depth)):
            out[g].append(k)
        return out

    @cached_property
    def children(self) -> list[list[list[int]]]:
        """By depth from 0: for each prefix, the places of those that are one code longer."""
        out = []
        for d in range(len(self.levels)):
            place = {p: k for k, p in enumerate(self.prefixes[d])}
            own: list[list[int]] = [[] for _ in place]
            for k, p in enumerate(self.prefixes[d + 1]):
                own[place[p[:d]]].append(k)
            out.append(own)
        return out

    def last_codes(self, depth: int) -> list[int]:
        return [p[-1] for p in self.prefixes[depth]]

    def parents(self, depth: int) -> list[int]:
        place = {p: k for k, p in enumerate(self.prefixes[depth - 1])}
        return [place[p[:-1]] for p in self.prefixes[depth]]

    def table(self, spark: SparkSession) -> DataFrame:
        """path_idx, c1..cL, n."""
        names = [f"c{k + 1} int" for k in range(len(self.levels))]
        return spark.createDataFrame([(k, *p, n) for k, (p, n) in enumerate(zip(self.paths, self.counts, strict=True))], ", ".join(["path_idx int", *names, "n long"]))

    def encode(self, df: DataFrame) -> DataFrame:
        """df with code_<level>: place in the sorted classes, -1 for classes not in the tree and nulls."""
        return df.withColumns({f"code_{c}": self.code(F.col(c), k) for k, c in enumerate(self.levels)})

    def code(self, label: Column, level: int) -> Column:
        return F.coalesce(F.array_position(F.lit(list(self.classes[level])), label.cast("string")).cast("int") - 1, F.lit(-1))

    def decode(self, code: Column, level: int) -> Column:
        return F.when(code >= 0, F.get(F.lit(list(self.classes[level])), code))


def known_rows(df: DataFrame, tree: Tree) -> DataFrame:
    """Rows all of whose labels are classes of the tree."""
    return df.where(reduce(lambda a, b: a & b, (F.col(c).cast("string").isin(*own) for c, own in zip(tree.levels, tree.classes, strict=True))))


def _log(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(F.greatest(x.cast("double"), F.lit(A.FLOOR))))


def path_scores(df: DataFrame, tree: Tree, probs: Sequence[str], mode: str = "independent", out: str = "scores") -> DataFrame:
    """df with the log score of every path. independent: the sum of the levels' logs. conditional: each level's shares
    are taken among the children of one parent first, so that the paths' probabilities sum to 1."""
    logs = [_log(F.col(c)).alias(f"log{k}") for k, c in enumerate(probs)]

    def with_parents(v: Column) -> Column:
        """The levels' logs and, for each parent, the log of its children's sum."""
        out = [v[f"log{k}"].alias(f"log{k}") for k in range(len(probs))]
        for k in range(len(probs)):
            children = [[p[k] for p in tree.prefixes[k + 1] if p[:k] == parent] for parent in tree.prefixes[k]]
            out.append(F.transform(F.lit(children), _sum_exp(v[f"log{k}"])).alias(f"under{k}"))
        return F.struct(*out)

    def summed(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(len(tree.paths) - 1)), lambda i: reduce(lambda a, b: a + b, (term(v, k, i) for k in range(len(probs)))))

    def term(v: Column, k: int, i: Column) -> Column:
        own = F.get(v[f"log{k}"], F.get(F.lit([p[k] for p in tree.paths]), i))
        return own - F.get(v[f"under{k}"], F.get(F.lit(tree.prefix_of_path(k)), i)) if mode == "conditional" else own

    bound = A.bind(F.struct(*logs), with_parents) if mode == "conditional" else F.struct(*logs)
    return df.withColumn(out, A.bind(bound, summed))


def _sum_exp(logs: Column):
    return lambda codes: A.log_sum_exp(F.transform(codes, lambda c: F.get(logs, c)))


def best_paths(df: DataFrame, tree: Tree, k: int = 3, scores: str = "scores") -> DataFrame:
    """df with `paths`: array<struct<path, probability, evidence>> of the k best, ties by path, and `path_probs`."""
    def with_probabilities(v: Column) -> Column:
        probs = F.transform(v["s"], lambda x: F.exp(x - v["t"]))
        tops = F.transform(A.top_places(v["s"], min(k, len(tree.paths))), lambda x: F.struct(x["place"].alias("path"), F.exp(x["value"] - v["t"]).alias("probability"), F.exp(x["value"]).alias("evidence")))
        return F.struct(probs.alias("probs"), tops.alias("tops"))

    both = A.bind(F.struct(F.col(scores).alias("s"), A.log_sum_exp(F.col(scores)).alias("t")), with_probabilities)
    return df.withColumn("_both", both).withColumns({"path_probs": F.col("_both.probs"), "paths": F.col("_both.tops")}).drop("_both")


def trie_paths(df: DataFrame, tree: Tree, probs: Sequence[str], mode: str = "independent", k: int = 3) -> DataFrame:
    """df with `paths` as best_paths gives them, and `n_scored`, how many steps of paths were scored for the row.

    The tree is walked by depth, and a prefix is scored once for all its paths. A score only falls with a longer prefix. So
    the k best prefixes of each depth lead to k paths whose worst is a bound, and no path under a prefix below it can be
    among the k best: a second walk keeps all other prefixes, whose paths are the exact answer, ties by path. The sum over
    all paths, which probabilities need, is that of the children's sums from the deepest level up (conditional: 1)."""
    k = min(k, len(tree.paths))
    codes = [tree.last_codes(d + 1) for d in range(len(tree.levels))]

    def walked(v: Column) -> Column:
        def share(d: int, node: Column) -> Column:
            return F.greatest(F.get(v[f"p{d}"], F.get(F.lit(codes[d]), node)).cast("double"), F.lit(A.FLOOR))

        def longer(front: Column, d: int) -> Column:
            """The children of all prefixes of a front, each with its score below 0 turned round."""
            def of_one(x: Column) -> Column:
                def scored(own: Column) -> Column:
                    under = F.log(F.aggregate(own, F.lit(0.0), lambda a, c: a + share(d, c))) if mode == "conditional" else F.lit(0.0)
                    return A.bind(under, lambda t: F.transform(own, lambda c: F.struct((x["minus"] - (F.log(share(d, c)) - t)).alias("minus"), c.alias("node"))))

                return A.bind(F.get(F.lit(tree.children[d]), x["node"]), scored)

            return F.flatten(F.transform(front, of_one))

        root = F.array(F.struct(F.lit(0.0).alias("minus"), F.lit(0).alias("node")))
        beam = root
        for d in range(len(codes)):
            beam = F.slice(F.array_sort(longer(beam, d)), 1, k)

        def exact(limit: Column) -> Column:
            def step(d: int) -> Callable[[Column], Column]:
                kept = lambda new: F.filter(new, lambda x: x["minus"] <= limit)
                return lambda s: A.bind(longer(s["front"], d), lambda new: F.struct(kept(new).alias("front"), (s["n"] + F.size(new)).alias("n")))

            state = F.struct(root.alias("front"), F.lit(0).alias("n"))
            for d in range(len(codes)):
                state = A.bind(state, step(d))
            return A.bind(state, lambda s: F.struct(F.slice(F.array_sort(s["front"]), 1, k).alias("tops"), s["n"].alias("n")))

        return A.bind(F.coalesce(F.get(beam, k - 1)["minus"], F.lit(float("inf"))), exact)

    found = A.bind(F.struct(*[F.col(c).alias(f"p{d}") for d, c in enumerate(probs)]), walked)
    whole = F.lit(1.0) if mode == "conditional" else A.bind(F.struct(*[F.col(c).alias(f"p{d}") for d, c in enumerate(probs)]), lambda v: A.total(_sums_from_below(tree, v)[0]))
    out = df.withColumn("_found", found).withColumn("_whole", whole)
    tops = F.transform("_found.tops", lambda x: F.struct(x["node"].alias("path"), (F.exp(-x["minus"]) / F.col("_whole")).alias("probability"), F.exp(-x["minus"]).alias("evidence")))
    return out.withColumns({"paths": tops, "n_scored": F.col("_found.n")}).drop("_found", "_whole")


def _sums_from_below(tree: Tree, v: Column) -> list[Column]:
    """By depth from 1: the sum over the paths under each prefix of the products of their shares from its own level on."""
    depth = len(tree.levels)
    out = [_shares(tree, v, depth - 1)]
    for d in range(depth - 2, -1, -1):
        out.insert(0, F.zip_with(_shares(tree, v, d), A.bind(out[0], _sums_of(tree.children[d + 1])), lambda p, s: p * s))
    return out


def _shares(tree: Tree, v: Column, d: int) -> Column:
    """The level's own share of each prefix of d + 1 codes."""
    return F.transform(F.lit(tree.last_codes(d + 1)), lambda c: F.greatest(F.get(v[f"p{d}"], c).cast("double"), F.lit(A.FLOOR)))


def _sums_of(places: list[list[int]]) -> Callable[[Column], Column]:
    return lambda values: F.transform(F.lit(places), lambda own: F.aggregate(own, F.lit(0.0), lambda a, c: a + F.get(values, c)))


def trie_masses(df: DataFrame, tree: Tree, probs: Sequence[str], mode: str = "independent") -> DataFrame:
    """df with prefix_<d>, mass_<d> and margin_<d> as prefix_masses gives them, from sums by prefix: those of the paths below
    from the deepest level up, then each prefix's part of what the one before it has."""
    given = F.struct(*[F.col(c).alias(f"p{d}") for d, c in enumerate(probs)])
    depth = len(tree.levels)

    def all_masses(v: Column) -> Column:
        if mode == "conditional":
            sums = [_shares(tree, v, d) for d in range(depth)]
        else:
            sums = _sums_from_below(tree, v)
        return A.bind(F.struct(*[x.alias(f"s{d}") for d, x in enumerate(sums)]), from_above)

    def from_above(v: Column) -> Column:
        def step(d: int) -> Callable[[Column], Column]:
            return lambda s: F.struct(*[s[f"m{j}"].alias(f"m{j}") for j in range(d + 1)], part(v[f"s{d}"], s[f"m{d}"], d).alias(f"m{d + 1}"))

        state = F.struct(F.array(F.lit(1.0)).alias("m0"))
        for d in range(depth):
            state = A.bind(state, step(d))
        return state

    def part(sums: Column, above: Column, d: int) -> Column:
        return A.bind(_sums_of(tree.children[d])(sums), lambda w: F.transform(F.lit(tree.parents(d + 1)), lambda parent, i: F.get(above, parent) * F.get(sums, i) / F.get(w, parent)))

    df = df.withColumn("_masses", A.bind(given, all_masses))
    for d in range(1, depth + 1):
        df = df.withColumn("_mass", A.bind(F.col(f"_masses.m{d}"), _heaviest(tree.prefixes[d])))
        df = df.withColumns({f"{name}_{d}": F.col(f"_mass.{name}") for name in ("prefix", "mass", "margin")}).drop("_mass")
    return df.drop("_masses")


def prefix_masses(df: DataFrame, tree: Tree) -> DataFrame:
    """df with, for each depth d, prefix_<d> (the codes of the heaviest prefix), mass_<d> and margin_<d>."""
    for d in range(1, len(tree.levels) + 1):
        mass = A.bind(F.col("path_probs"), _masses(tree.members(d)))
        df = df.withColumn("_mass", A.bind(mass, _heaviest(tree.prefixes[d])))
        df = df.withColumns({f"{name}_{d}": F.col(f"_mass.{name}") for name in ("prefix", "mass", "margin")}).drop("_mass")
    return df


def _masses(members: list[list[int]]):
    return lambda p: F.transform(F.lit(members), lambda own: F.aggregate(own, F.lit(0.0), lambda a, i: a + F.get(p, i)))


def _heaviest(prefixes: list[tuple[int, ...]]):
    def best(m: Column) -> Column:
        margin = A.margin(m) if len(prefixes) > 1 else F.array_max(m)
        return F.struct(F.get(F.lit([list(p) for p in prefixes]), A.arg_max(m)).alias("prefix"), F.array_max(m).alias("mass"), margin.alias("margin"))

    return best


def level_argmax(df: DataFrame, tree: Tree, probs: Sequence[str]) -> DataFrame:
    """Each level for itself: predicted_<level>, confidence_<level>, margin_<level>. Levels may disagree."""
    new = {}
    for k, (c, p) in enumerate(zip(tree.levels, probs, strict=True)):
        new |= {f"predicted_{c}": tree.decode(A.arg_max(F.col(p)), k), f"confidence_{c}": F.array_max(p).cast("double"), f"margin_{c}": A.margin(F.col(p))}
    return df.withColumns(new)


def predictions(df: DataFrame, tree: Tree, probs: Sequence[str], mode: str = "independent", k: int = 3, prefixes: bool = True) -> DataFrame:
    """df with predicted_<level>, confidence, path_evidence, alternatives, level_confidence_<level>, entropy; with
    prefixes mass_<depth> and margin_<depth>. mode: independent, conditional or argmax."""
    if mode == "argmax":
        out = level_argmax(df, tree, probs).withColumn("confidence", F.col(f"confidence_{tree.levels[-1]}"))
        return out.withColumn("entropy", A.entropy(F.col(probs[-1])))
    out = trie_paths(df, tree, probs, mode, k)
    best = F.get("paths", 0)
    new = {"confidence": best["probability"], "path_evidence": best["evidence"], "entropy": A.entropy(F.col(probs[-1]))}
    for j, c in enumerate(tree.levels):
        code = F.get(F.lit([p[j] for p in tree.paths]), best["path"])
        new |= {f"predicted_code_{c}": code, f"predicted_{c}": tree.decode(code, j), f"level_confidence_{c}": F.get(F.col(probs[j]), code).cast("double")}
    names = F.lit(["|".join(tree.classes[j][p[j]] for j in range(len(p))) for p in tree.paths])
    new["alternatives"] = F.transform(F.slice("paths", 2, max(k - 1, 1)), lambda x: F.struct(F.get(names, x["path"]).alias("path"), x["probability"].alias("probability")))
    out = out.withColumns(new)
    return (trie_masses(out, tree, probs, mode) if prefixes else out).drop("n_scored", "paths")


def averaged(one: DataFrame, two: DataFrame, key: str, probs: Sequence[str], trees: tuple[Tree, Tree]) -> DataFrame:
    """The mean of two models' probabilities; the trees must be the same."""
    if trees[0].classes != trees[1].classes or trees[0].paths != trees[1].paths:
        raise ValueError("the models' trees differ")
    other = two.select(key, *[F.col(p).alias(f"_{p}") for p in probs])
    joined = one.join(other, key)
    return joined.withColumns({p: A.mean_of(F.col(p), F.col(f"_{p}")) for p in probs}).drop(*[f"_{p}" for p in probs])
