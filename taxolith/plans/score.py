"""Scoring new rows from end to end: one lazy plan of per-row expressions and broadcast joins, for tables and streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.functions import text as T
from taxolith.functions import tokens as N
from taxolith.operators import calibration, cleaning, hierarchy, taxonomy
from taxolith.operators.filters import check_columns
from taxolith.operators.sparse import TableModel
from taxolith.sources.bundle import Bundle

DEFAULT_CUT = 0.6


def readability(df: DataFrame, text_col: str, known: Column | Sequence[str]) -> DataFrame:
    """n_tokens, n_known_tokens (tokens that are known, each time they occur), known_share. known: an array column, or the
    features of a vectorizer, of which the single words count; they are looked up by hash."""
    tokens = N.tokenize(F.col(text_col))
    if isinstance(known, Column):
        n_known = F.size(F.filter(tokens, lambda t: F.array_contains(known, t)))
    elif words := [w for w in known if " " not in w]:
        counter = CountVectorizerModel.from_vocabulary(words, inputCol="_tokens", outputCol="_known")
        df, n_known = counter.transform(df.withColumn("_tokens", tokens)), A.total(F.unwrap_udt("_known")["values"]).cast("int")
    else:
        n_known = F.lit(0)
    out = df.withColumns({"n_tokens": F.size(tokens), "n_known_tokens": n_known})
    return out.withColumn("known_share", F.when(F.col("n_tokens") > 0, F.col("n_known_tokens") / F.col("n_tokens")).otherwise(0.0)).drop("_tokens", "_known")


def limits_of(bundle: Bundle, given: Mapping[int, float | None] | None) -> tuple[str, Mapping[int, float | None]] | None:
    """Which thresholds hold: given ones, the levels' own, those of the joint mass."""
    if given is not None:
        return "level", given
    for kind in ("level", "prefix"):
        if bundle.thresholds.get(kind):
            return kind, bundle.thresholds[kind]
    return None


def score(
    df: DataFrame, bundle: Bundle, features: str = "features", text_col: str | None = None, mode: str = "independent", top: int = 3, least_known: int = 1,
    thresholds: Mapping[int, float | None] | None = None, lookup: DataFrame | None = None, names: Sequence[str] = (), markers: Mapping[str, Mapping] | None = None, carry: Sequence[str] | None = None,
    key: str | None = None,
) -> DataFrame:
    """Every row of df with predictions, confidences, assigned depth, review flag and reason, and names by path.

    With text_col the text is cleaned and vectorised as in training (the bundle's table `vocabulary`, if it has one, says
    which leading words are codes); without, `features` is there already. A bundle whose model is a table of terms joins
    the texts with it by their `key`, a column of unique values; that is for tables, not for streams."""
    tree, by_table = bundle.models.tree, isinstance(bundle.models, TableModel)
    if by_table and not (text_col and key):
        raise ValueError("a table of terms needs the texts and their key")
    if text_col:
        check_columns(df, [text_col, *(markers or {}), *(carry or []), *([key] if by_table else [])])
        df = df.withColumn("_clean", F.coalesce(F.col(text_col), F.lit("")))
        if bundle.cleaner:
            df = cleaning.applied(df, "_clean", cleaning.Cleaner(**bundle.cleaner), bundle.tables.get("vocabulary"), markers)
        elif markers:
            df = df.withColumn("_clean", T.with_markers(F.col("_clean"), [T.marker(F.col(c), m.get("prefix", ""), m.get("levels", ()), m.get("missing")) for c, m in markers.items()]))
        if by_table:
            df, probs = bundle.models.probabilities(df, key, "_clean")
        else:
            df = readability(bundle.vectorizer.transform(df), "_clean", bundle.vectorizer.stages[-1].vocabulary)
    else:
        check_columns(df, [features, *(carry or [])])
    if not by_table:
        df, probs = bundle.models.probabilities(df, features)
    for p, t in zip(probs, bundle.temperatures or [], strict=False):
        df = calibration.with_temperature(df.withColumn(p, F.transform(p, lambda x: F.log(F.greatest(x, F.lit(A.FLOOR))))), p, t, p)
    out = hierarchy.predictions(df, tree, probs, mode, top)
    unreadable = F.col("n_known_tokens") < least_known if "n_known_tokens" in out.columns else F.lit(False)
    chosen = limits_of(bundle, thresholds)
    if chosen:
        out = (calibration.cascade_by_level if chosen[0] == "level" else calibration.cascade_by_prefix)(out, tree.levels, chosen[1])
        below = F.col("needs_review")
    else:
        below = F.col("confidence") < DEFAULT_CUT
    reason = F.when(unreadable, "unreadable").when(below, "below threshold").otherwise("")
    out = out.withColumn("review_reason", reason).withColumn("needs_review", F.col("review_reason") != "")
    if lookup is not None:
        own = lookup.select(*[F.col(c).alias(f"predicted_{c}") for c in tree.levels], *names)
        out = taxonomy.attach_names(out, own, [f"predicted_{c}" for c in tree.levels], names)
    return out.drop("_clean", "_grams", *probs)


def score_to(df: DataFrame, path: str, kind: str = "parquet", **how) -> None:
    """Scores written partition by partition as they come."""
    score(df, **how).drop("features").write.mode("overwrite").format(kind).save(path)
