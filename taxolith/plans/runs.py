"""Registered queries of calibration fits, of models of one's own and of resumable runs, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolith.operators import features, hierarchy, models, splits
from taxolith.plans import crossval
from taxolith.plans.queries import _BASE, HELD, LEVELS, ORACLES, _vectors, query, read, rounded
from taxolith.plans.recipes import _OOF, _folder

# ---- calibration: SQL halves an interval around the zero of the slope, and takes least of greatest means for the steps

ORACLES["temperature"] = _BASE.replace("WITH v AS", "WITH RECURSIVE v AS", 1) + """, lg AS MATERIALIZED (SELECT vec_id, zs, zs[k2.k] AS own, list_max(zs) AS top FROM (SELECT vec_id, t2, [ln(greatest(q, 1e-12)) for q in p2] AS zs FROM z) JOIN k2 ON k2.n = t2),
long AS MATERIALIZED (SELECT vec_id, own, top, unnest(zs) AS x FROM lg),
half AS (SELECT 0 AS step, -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi UNION ALL SELECT step + 1, CASE WHEN slope > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE hi END FROM
 (SELECT step, lo, hi, avg(own - mean) AS slope FROM (SELECT step, lo, hi, vec_id, any_value(own) AS own, sum(x * exp((x - top) / exp((lo + hi) / 2))) / sum(exp((x - top) / exp((lo + hi) / 2))) AS mean FROM half, long WHERE step < 50 GROUP BY step, lo, hi, vec_id) GROUP BY step, lo, hi)),
t AS (SELECT exp((lo + hi) / 2) AS t FROM half WHERE step = 50)
SELECT vec_id, round(1 / sum(exp((x - top) / t)), 6) AS confidence, round(any_value(t), 6) AS temperature FROM long, t GROUP BY vec_id"""

ORACLES["isotonic"] = _BASE + """, u AS (SELECT b AS x, sum((t2 = c2)::INT) AS s, count(*) AS n FROM z GROUP BY 1),
i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x) AS i, x, s, n, sum(s) OVER (ORDER BY x) AS ss, sum(n) OVER (ORDER BY x) AS nn FROM u),
low AS (SELECT a, k, min(m) OVER (PARTITION BY a ORDER BY k DESC) AS m FROM (SELECT p.i AS a, q.i AS k, (q.ss - p.ss + p.s)::DOUBLE / (q.nn - p.nn + p.n) AS m FROM i p JOIN i q ON q.i >= p.i)),
f AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS nx, lead(y) OVER (ORDER BY x) AS ny FROM (SELECT i.x, max(m) AS y FROM low JOIN i ON i.i = k GROUP BY 1)),
w AS (SELECT vec_id, list_max(p2) AS top, list_sum(p2) AS whole, list_sort(p2, 'DESC')[2] AS second FROM z),
c AS (SELECT w.*, least(greatest(y + CASE WHEN nx IS NULL THEN 0 ELSE (top - x) * (ny - y) / (nx - x) END, 1e-12), 1 - 1e-12) AS new FROM w ASOF JOIN f ON w.top >= f.x)
SELECT vec_id, round(greatest(new, second * (1 - new) / greatest(1 - top, 1e-12)), 6) AS confidence, round(new + (whole - top) * (1 - new) / greatest(1 - top, 1e-12), 6) AS total FROM c"""


# ---- models of one's own, and how a fit went

class Shares:
    """A model that gives every row the shares of the classes among the rows it has learned from."""

    def __init__(self, counts: dict[int, int], n: int):
        total = max(sum(counts.values()), 1)
        self.shares = [counts.get(k, 0) / total for k in range(n)]

    def probabilities(self, features: str):
        return F.lit(self.shares)


def _shares(df, features, code, n):
    return Shares({r[code]: r["count"] for r in df.where(F.col(code) >= 0).groupBy(code).count().collect()}, n)  # one row a class


@query("""WITH v AS (SELECT vec_id, (label // 5)::INT::VARCHAR AS l1, label::VARCHAR AS l2 FROM embeddings), n AS (SELECT count(*) AS n FROM v),
a AS (SELECT l1, count(*) AS k FROM v GROUP BY 1 ORDER BY k DESC, l1 LIMIT 1), b AS (SELECT l2, count(*) AS k FROM v GROUP BY 1 ORDER BY k DESC, l2 LIMIT 1)
SELECT vec_id, a.l1 AS predicted_l1, b.l2 AS predicted_l2, round(a.k / n, 6) AS confidence_l1, round(b.k / n, 6) AS confidence_l2 FROM v, n, a, b""")
def own_model(spark, sf):
    """A model added to the registry under its own name, fitted and applied like the others."""
    models.register("shares", _shares, "one aggregation")
    rows = _vectors(spark, sf)
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = models.fit_levels(rows, tree, "embedding", "shares").probabilities(rows, "embedding")
    return rounded(hierarchy.level_argmax(df, tree, probs).select("vec_id", "predicted_l1", "predicted_l2", "confidence_l1", "confidence_l2"))


@query("""WITH c AS (SELECT 'l1' AS level, (label // 5)::VARCHAR AS c FROM embeddings UNION ALL SELECT 'l2', label::VARCHAR FROM embeddings), n AS (SELECT level, c, count(*) AS n FROM c GROUP BY 1, 2)
SELECT level, round(-sum(n / t * ln((n + 1) / (t + k))), 6) AS first, 0::BIGINT AS rises, true AS learned FROM (SELECT level, n, sum(n) OVER (PARTITION BY level) AS t, count(*) OVER (PARTITION BY level) AS k FROM n) GROUP BY 1""")
def fit_history(spark, sf):
    """The objective by step of a logistic fit a level: it starts at that of the classes' shares, each
    counted once more, and never rises."""
    rows = _vectors(spark, sf)
    steps = models.history(models.fit_levels(rows, hierarchy.Tree.fit(rows, LEVELS), "embedding", "logistic"), spark)
    own = F.array_sort(F.collect_list(F.struct("step", "objective")))
    table = steps.groupBy("level").agg(F.transform(own, lambda x: x["objective"]).alias("o"))
    moves = F.zip_with(F.slice("o", F.lit(2), F.size("o") - 1), F.slice("o", F.lit(1), F.size("o") - 1), lambda b, a: b - a)
    return rounded(table.select("level", F.get("o", 0).alias("first"), F.size(F.filter(moves, lambda m: m > 1e-9)).cast("long").alias("rises"), (F.element_at("o", -1) < F.get("o", 0)).alias("learned")))


# ---- resumable runs: what is refused, what an unfinished one gives

@query(_OOF + " SELECT vec_id, fold, ok = 1 AS right_l2 FROM s WHERE fold IN (0, 3)")
def partial_run(spark, sf):
    """An unfinished run: it is refused as a whole, and gives the rows of its finished folds where that is allowed."""
    path, rows = _folder(spark, "run"), _vectors(spark, sf)
    crossval.run(spark, rows, path, "vec_id", "embedding", ["l2"], only=[0, 3])
    try:
        crossval.collect_folds(spark, path, 5)
    except ValueError:
        done = crossval.collect_folds(spark, path, 5, partial=True)
        return done.select("vec_id", "fold", (F.col("predicted_l2") == F.col("l2")).alias("right_l2"))
    raise AssertionError("an unfinished run was given as a whole")


def _fingerprint_sql(row: str, rows: str) -> str:
    return f"(SELECT count(*) AS n, (sum(('0x' || substr(sha1({row}), 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS h FROM {rows})"


_VEC_ROW = "length(vec_id::VARCHAR) || ':' || vec_id || length(l1) || ':' || l1 || length(l2) || ':' || l2"
_EMB = "(SELECT vec_id, (label // 5)::INT::VARCHAR AS l1, label::VARCHAR AS l2, label FROM embeddings)"
_ID_ROW = "length(vec_id::VARCHAR) || ':' || vec_id"


@query(f"""WITH a AS {_fingerprint_sql(_VEC_ROW, _EMB)}, b AS {_fingerprint_sql(_VEC_ROW, f"{_EMB} WHERE label <> 9")}, x AS {_fingerprint_sql(_ID_ROW, f"{_EMB} WHERE label = 3")}, y AS {_fingerprint_sql(_ID_ROW, f"{_EMB} WHERE label = 4")}
SELECT 'config.k: 5 is now 4' AS difference UNION ALL SELECT 'data.fingerprint: ''' || a.h || ''' is now ''' || b.h || '''' FROM a, b UNION ALL SELECT 'data.rows: ' || a.n || ' is now ' || b.n FROM a, b WHERE a.n <> b.n
UNION ALL SELECT 'blacklist.fingerprint: ''' || x.h || ''' is now ''' || y.h || '''' FROM x, y UNION ALL SELECT 'blacklist.rows: ' || x.n || ' is now ' || y.n FROM x, y WHERE x.n <> y.n""")
def refused_run(spark, sf):
    """A run that goes on with other rows, settings and excluded keys is refused with all that differs; what may differ
    (a comment) is not among it."""
    path, rows = _folder(spark, "run"), _vectors(spark, sf)
    excluded = lambda label: rows.where(F.col("l2") == label).select(F.col("vec_id").alias("id"))
    go = lambda df, **how: crossval.run(spark, df, path, "vec_id", "embedding", LEVELS, only=[], **how)
    go(rows, blacklist=excluded("3"), config={"comment": "first"})
    try:
        go(rows.where("l2 <> '9'"), k=4, blacklist=excluded("4"), config={"comment": "second"})
    except ValueError as refusal:
        found = str(refusal).split(": ", 1)[1].split("; ")
        return spark.createDataFrame([(x,) for x in found], "difference string")
    raise AssertionError("another run was taken up")


_LONE = f"(SELECT doc_id, CASE WHEN {HELD} = 2 AND doc_id % 7 = 0 THEN 'only here' ELSE lang END AS lang, {HELD} AS fold FROM documents)"


@query(f"SELECT doc_id, true AS winnable FROM {_LONE} WHERE fold = 2 AND lang IN (SELECT lang FROM {_LONE} WHERE fold <> 2) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def winnable_rows(spark, sf):
    """Held-out rows without those whose class the training rows lack, and without excluded keys, which go from both sides."""
    docs = splits.id_hash_fold(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    docs = docs.withColumn("lang", F.when((F.col("fold") == 2) & (F.col("doc_id") % 7 == 0), "only here").otherwise(F.col("lang")))
    toxic = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    how = features.Features("count", min_df=3, max_df=1.0, most=None, binary=True)
    out, _, _ = crossval.recipe_fold(docs, 2, "doc_id", "text", ["lang"], how, blacklist=toxic, scope="all", keep_unwinnable=False)
    return out.select("doc_id", "winnable")
