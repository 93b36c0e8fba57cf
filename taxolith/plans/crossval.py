"""Out-of-fold predictions that can be resumed: a folder a fold, a JSON record of the run, and a marker a finished fold."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.operators import evaluation, features, filters, hierarchy, models, sparse, splits, tokens
from taxolith.sources.bundle import read_text, there, write_text
from taxolith.sources.io import stored

#: Settings that may differ when a run goes on.
VOLATILE = ("path", "partitions", "comment")
#: Models that a term table serves, by their registered names.
BY_TABLE = {"multinomial_nb": "bayes", "centroid": "cosine"}


def out_of_fold(df: DataFrame, key: str, column: str, levels: Sequence[str], k: int = 5, model: str = "centroid", fold: str | None = None) -> DataFrame:
    """Every row with its fold and the probabilities of a model that has not seen it."""
    tree = hierarchy.Tree.fit(df, levels)
    rows = df.withColumnRenamed(fold, "fold") if fold else splits.stratified_fold(df, levels[-1], key, k)
    parts = []
    for f in range(k):
        own = models.fit_levels(rows.where(F.col("fold") != f), tree, column, model)
        parts.append(own.probabilities(rows.where(F.col("fold") == f), column)[0])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recipe_fold(
    rows: DataFrame, held: int, key: str, text_col: str, levels: Sequence[str], how: features.Features, model: str = "multinomial_nb", blacklist: DataFrame | None = None, scope: str = "train",
    min_count: int = 1, keep_unwinnable: bool = True, fold: str = "fold", counted: DataFrame | None = None,
) -> tuple[DataFrame, models.LevelModels | sparse.TableModel, dict]:
    """One fold's whole recipe: excluded keys, rare tokens, the tree, the vectorizer and the models are all learned from the
    other folds' rows alone; then the held-out rows are scored. Returns their scores, the models, and what was learned.

    Held-out rows of a class that the training rows lack can't be won: they stay, marked `winnable`, or go. counted: the rows'
    `counted_by_fold`, from which those of the other folds are summed; without it the training rows' terms are counted here."""
    train, own = rows.where(F.col(fold) != held), rows.where(F.col(fold) == held)
    if blacklist is not None:
        train, own = filters.scoped(train, own, blacklist, key, scope)
    train, (own,), _ = tokens.drop_rare_tokens(train, [own], key, text_col, min_count)
    tree = hierarchy.Tree.fit(train, levels)
    coded = tree.encode(own)
    own = coded.withColumn("winnable", F.least(*[F.col(f"code_{c}") for c in levels], F.lit(0)) >= 0).drop(*[f"code_{c}" for c in levels])
    if not keep_unwinnable:
        own = own.where("winnable")
    if how.most is None and model in BY_TABLE:  # a vocabulary without a cap stays a table
        others = None if counted is None else counted.withColumn("cells", F.filter("cells", lambda x: x[fold] != held))
        fitted = sparse.fit_table(train, key, text_col, tree, how, BY_TABLE[model], counted=others)
        scored, probs = fitted.probabilities(own, key, text_col)
        scored, n_features = scored.drop("n_tokens", "n_known_tokens", "known_share"), fitted.n_terms
    else:
        vectorizer = features.fitted(how, train, text_col)
        fitted = models.fit_levels(vectorizer.transform(train), tree, "features", model)
        scored, probs = fitted.probabilities(vectorizer.transform(own), "features")
        n_features = len(vectorizer.stages[-1].vocabulary)
    out = hierarchy.predictions(scored, tree, probs, prefixes=False).drop(*probs, "features", "_grams", "alternatives", *[f"predicted_code_{c}" for c in levels])
    return out, fitted, {"features": n_features, "paths": len(tree.paths)}


def counted_by_fold(rows: DataFrame, key: str, text_col: str, levels: Sequence[str], how: features.Features, blacklist: DataFrame | None = None, fold: str = "fold") -> DataFrame:
    """Each term's counts by fold and labels, written: the texts are read once for all folds, of which each sums the others'."""
    train = rows if blacklist is None else filters.drop_ids(rows, blacklist, key)
    return stored(sparse.class_counts(train, key, text_col, [fold, *levels], how), "folds")


def run_recipe(
    spark: SparkSession, df: DataFrame, path: str, key: str, text_col: str, levels: Sequence[str], how: features.Features, k: int = 5, seed: int = 0, only: Sequence[int] | None = None,
    blacklist: DataFrame | None = None, config: Mapping | None = None, **recipe,
) -> None:
    """run() for texts: every fold learns its own vocabulary, tree and models (recipe_fold) and is written when it is done."""
    settings = {"k": k, "seed": seed, "levels": list(levels), "text": text_col, "features": dataclasses.asdict(how), **{n: v for n, v in recipe.items() if isinstance(v, str | int | float | bool)}, **(config or {})}
    started(spark, df, path, key, identity(df, key, [text_col, *levels], settings, blacklist))
    rows = splits.id_hash_fold(df, key, k, seed)
    due = [f for f in (only if only is not None else range(k)) if not there(spark, f"{path}/done_{f}.json")]
    by_table = how.most is None and recipe.get("model", "multinomial_nb") in BY_TABLE and recipe.get("min_count", 1) <= 1  # else a fold has texts or features of its own
    counted = counted_by_fold(rows, key, text_col, levels, how, blacklist) if by_table and len(due) > 1 else None
    for f in due:
        scored, _, learned = recipe_fold(rows, f, key, text_col, levels, how, blacklist=blacklist, counted=counted, **recipe)
        scored.drop("fold").write.mode("overwrite").parquet(f"{path}/fold={f}")
        done = spark.read.parquet(f"{path}/fold={f}")
        stats = done.agg(F.count("*").alias("rows"), F.avg((~F.col("winnable")).cast("int")).alias("unseen_share")).first().asDict()
        write_text(spark, f"{path}/done_{f}.json", json.dumps(stats | learned | {"accuracy": evaluation.path_accuracy(done, levels).first().accuracy}))


def started(spark: SparkSession, df: DataFrame, path: str, key: str, record: Mapping) -> None:
    """Write the run's record, or hold it against the one that is there."""
    if there(spark, f"{path}/run.json"):
        if bad := differences(json.loads(read_text(spark, f"{path}/run.json")), record):
            raise ValueError("the folder holds another run: " + "; ".join(bad))
    else:
        if filters.duplicate_ids(df, key).first().n_duplicates:
            raise ValueError("keys are not unique")
        write_text(spark, f"{path}/run.json", json.dumps(record))


def identity(df: DataFrame, key: str, columns: Sequence[str], config: Mapping, blacklist: DataFrame | None = None) -> dict:
    """What makes two runs the same: settings, data, excluded keys."""
    record = {"config": {k: v for k, v in config.items() if k not in VOLATILE}, "data": splits.data_fingerprint(df, [key, *columns]).first().asDict()}
    record["blacklist"] = splits.id_fingerprint(blacklist).first().asDict() if blacklist is not None else None
    return json.loads(json.dumps(record))


def differences(a: Mapping, b: Mapping, at: str = "") -> list[str]:
    out = []
    for k in sorted({*a, *b}):
        x, y = a.get(k), b.get(k)
        if isinstance(x, dict) and isinstance(y, dict):
            out += differences(x, y, f"{at}{k}.")
        elif x != y:
            out.append(f"{at}{k}: {x!r} is now {y!r}")
    return out


def run(spark: SparkSession, df: DataFrame, path: str, key: str, column: str, levels: Sequence[str], k: int = 5, seed: int = 0, model: str = "centroid", config: Mapping | None = None, only: Sequence[int] | None = None, blacklist: DataFrame | None = None) -> None:
    """Score each fold by a model of the others. Finished folds are skipped; another run's folder is refused.

    Excluded keys are kept out of training but scored; held-out classes that the training rows lack are recorded."""
    record = identity(df, key, levels, {"k": k, "seed": seed, "model": model, "levels": list(levels), **(config or {})}, blacklist)
    started(spark, df, path, key, record)
    rows = splits.id_hash_fold(df, key, k, seed)
    for f in only if only is not None else range(k):
        if there(spark, f"{path}/done_{f}.json"):
            continue
        train = rows.where(F.col("fold") != f)
        train = filters.drop_ids(train, blacklist, key) if blacklist is not None else train
        tree = hierarchy.Tree.fit(train, levels)
        own = models.fit_levels(train, tree, column, model)
        held, probs = own.probabilities(rows.where(F.col("fold") == f), column)
        scored = tree.encode(hierarchy.predictions(held, tree, probs)).drop(*probs, column, "alternatives")
        scored.write.mode("overwrite").parquet(f"{path}/fold={f}")
        done = spark.read.parquet(f"{path}/fold={f}")
        unseen = F.least(*[F.col(f"code_{c}") for c in levels]) < 0 if len(levels) > 1 else F.col(f"code_{levels[0]}") < 0
        stats = done.agg(F.count("*").alias("rows"), F.avg(unseen.cast("int")).alias("unseen_share")).first().asDict()
        stats |= {"paths": len(tree.paths), "features": _width(train, column), "accuracy": evaluation.path_accuracy(done, levels).first().accuracy}
        write_text(spark, f"{path}/done_{f}.json", json.dumps(stats))  # last: a fold without it is done again


def _width(df: DataFrame, column: str) -> int | None:
    row = df.select(F.size(column).alias("n")).first() if dict(df.dtypes)[column].startswith("array") else None
    return row.n if row else None


def status(spark: SparkSession, path: str, k: int) -> DataFrame:
    """fold, done, rows, features, paths, accuracy, unseen_share."""
    rows = []
    for f in range(k):
        done = there(spark, f"{path}/done_{f}.json")
        stats = json.loads(read_text(spark, f"{path}/done_{f}.json")) if done else {}
        rows.append((f, done, *(stats.get(c) for c in ("rows", "features", "paths", "accuracy", "unseen_share"))))
    return spark.createDataFrame(rows, "fold int, done boolean, rows long, features int, paths int, accuracy double, unseen_share double")


def collect_folds(spark: SparkSession, path: str, k: int, partial: bool = False) -> DataFrame:
    """All folds' rows; an unfinished run is refused unless that is allowed."""
    done = [f for f in range(k) if there(spark, f"{path}/done_{f}.json")]
    if len(done) < k and not partial:
        raise ValueError(f"folds {sorted(set(range(k)) - set(done))} are not finished")
    return spark.read.option("basePath", path).parquet(*[f"{path}/fold={f}" for f in done])
