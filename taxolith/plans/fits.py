"""Registered queries of the models that are fitted by sums over the rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.functions import text as T
from taxolith.operators import features, filters, hierarchy, models, sparse, splits
from taxolith.plans import crossval, recipes
from taxolith.plans.queries import HELD, LEVELS, TOKENS, _softmax_sql, _vectors, query, read, rounded
from taxolith.plans.recipes import _folder
from taxolith.sources import io

# ---- support vectors on two features: SQL goes down the same strictly convex losses by fixed steps of its own

_VECS = "SELECT vec_id, label AS y, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, (('0x' || substr(sha1('0|' || vec_id), 1, 16))::UBIGINT % 5)::INT AS f FROM embeddings"
_M = "(w.a * x1 + w.b * x2 + w.i)"
_SHORT = f"CASE WHEN t * {_M} < 1 THEN -2 * t * (1 - t * {_M}) / n ELSE 0 END"
_SVC = f"""WITH RECURSIVE v AS ({_VECS}), k AS (SELECT DISTINCT y AS c FROM v), g AS (SELECT f::INT AS f, (SELECT count(*) FROM v WHERE v.f <> r.f) AS n FROM range(0, 5) r(f)), s AS (SELECT 1 / (2.1 + 2 * avg(x1 * x1 + x2 * x2)) AS s FROM v),
fit AS (SELECT 0 AS step, g.f, c, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS i, 0.0::DOUBLE AS pa, 0.0::DOUBLE AS pb, 0.0::DOUBLE AS pi FROM g, k
 UNION ALL SELECT step + 1, f, c, a - s * (a / n + ga), b - s * (b / n + gb), i - s * (i / n + gi), pa, pb, pi FROM
 (SELECT step, w.f, w.c, any_value(w.a) AS a, any_value(w.b) AS b, any_value(w.i) AS i, any_value(oa) AS pa, any_value(ob) AS pb, any_value(oi) AS pi, any_value(n) AS n, any_value(s) AS s, sum({_SHORT} * x1) AS ga, sum({_SHORT} * x2) AS gb, sum({_SHORT}) AS gi
  FROM (SELECT step, fit.f, c, a + 0.9 * (a - pa) AS a, b + 0.9 * (b - pb) AS b, i + 0.9 * (i - pi) AS i, a AS oa, b AS ob, i AS oi, n, s, y, x1, x2, CASE WHEN y = c THEN 1 ELSE -1 END AS t FROM fit JOIN g ON g.f = fit.f JOIN v ON v.f <> fit.f, s WHERE step < 300) w GROUP BY 1, 2, 3)),
m AS (SELECT w.f, w.c, w.a * x1 + w.b * x2 + w.i AS m, y = w.c AS hit FROM fit w JOIN v ON v.f = w.f WHERE step = 300),
h AS (SELECT f, c, (sum(hit::INT) + 1) / (sum(hit::INT) + 2) AS high, 1 / (count(*) - sum(hit::INT) + 2) AS low, avg(CASE WHEN hit THEN (p + 1) / (p + 2) ELSE 1 / (q + 2) END) AS level FROM (SELECT *, sum(hit::INT) OVER (PARTITION BY f, c) AS p, sum((NOT hit)::INT) OVER (PARTITION BY f, c) AS q FROM m) GROUP BY 1, 2),
curve AS (SELECT 0 AS step, f, c, 0.0::DOUBLE AS a, ln(level / (1 - level)) AS b FROM h
 UNION ALL SELECT step + 1, f, c, a + least(1, 4 / greatest(abs(da), abs(db), 1e-12)) * da, b + least(1, 4 / greatest(abs(da), abs(db), 1e-12)) * db FROM
 (SELECT *, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS da, (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS db FROM
  (SELECT step, f, c, any_value(a) AS a, any_value(b) AS b, sum((z - p) * m) AS ga, sum(z - p) AS gb, sum(p * (1 - p) * m * m) + 1e-9 AS haa, sum(p * (1 - p) * m) AS hab, sum(p * (1 - p)) + 1e-9 AS hbb
   FROM (SELECT step, u.f, u.c, a, b, m, CASE WHEN hit THEN high ELSE low END AS z, 1 / (1 + exp(-(m * a + b))) AS p FROM curve u JOIN m ON m.f = u.f AND m.c = u.c JOIN h ON h.f = u.f AND h.c = u.c WHERE step < 12) GROUP BY 1, 2, 3))),
r AS (SELECT u.f, u.c, w.a, w.b, w.i, greatest(u.a, 0) AS slope, CASE WHEN u.a < 0 THEN ln(level / (1 - level)) ELSE u.b END AS start FROM curve u JOIN h ON h.f = u.f AND h.c = u.c JOIN fit w ON w.f = u.f AND w.c = u.c WHERE u.step = 12 AND w.step = 300),
p AS (SELECT vec_id, c, sum(1 / (1 + exp(-((a * x1 + b * x2 + i) * slope + start)))) AS p FROM v, r GROUP BY 1, 2)
SELECT vec_id, round(any_value(p) FILTER (c = 0) / sum(p), 3) AS p_first, round(max(p) / sum(p), 3) AS confidence FROM p GROUP BY 1"""


@query(_SVC)
def svc_on_two(spark, sf):
    """Support vectors with curves fitted on five held-out folds, on two features."""
    rows = splits.id_hash_fold(_vectors(spark, sf).withColumn("two", F.slice("embedding", 1, 2)), "vec_id")
    tree = hierarchy.Tree.fit(rows, LEVELS[1:])
    own = models.fit_levels(rows, tree, "two", "linear_svc", folds=5, fold="fold")
    df, probs = own.probabilities(rows, "two")
    return rounded(df.select("vec_id", F.get(probs[0], 0).alias("p_first"), F.array_max(probs[0]).alias("confidence")), 3)


# ---- models whose weights are a table

_SPARSE = f"""WITH r AS (SELECT doc_id, c, token, count(*) AS tf FROM (SELECT doc_id, lang || '/' || source AS c, unnest({TOKENS}) AS token FROM documents) GROUP BY 1, 2, 3), k AS (SELECT token FROM r GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT * FROM r SEMI JOIN k USING (token)), m AS (SELECT c, token, sum(tf) AS n FROM h GROUP BY 1, 2), s AS (SELECT c, sqrt(sum(n * n)) AS s FROM m GROUP BY 1), x AS (SELECT doc_id, sqrt(sum(tf * tf)) AS x FROM h GROUP BY 1),
d AS (SELECT h.doc_id, m.c, sum(tf * n / s) AS dot FROM h JOIN m USING (token) JOIN s ON s.c = m.c GROUP BY 1, 2),
e AS (SELECT doc_id, c, exp(coalesce(dot / x, 0) / 0.1) AS e, coalesce(dot / x, 0) AS v FROM documents CROSS JOIN (SELECT DISTINCT lang || '/' || source AS c FROM documents) LEFT JOIN d USING (doc_id, c) LEFT JOIN x USING (doc_id))"""


@query(_SPARSE + " SELECT doc_id, round(max(e) / sum(e), 5) AS top, round(max(v), 5) AS cosine, count(*)::INT AS classes FROM e GROUP BY 1")
def sparse_centroids(spark, sf):
    """Nearest centroids over the counts of all terms, for a language's sources: weights in blocks of classes, met in a join."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", F.concat_ws("/", "lang", "source").alias("both"))
    tree = hierarchy.Tree.fit(docs, ["lang", "both"])
    own = sparse.fit_table(docs, "doc_id", "text", tree, features.Features("count", min_df=3, max_df=1.0, most=None), "cosine")
    sums = io.stored(own.sums(docs, "doc_id", "text"), "sums")
    df, probs = own.probabilities(docs, "doc_id", "text", sums)
    top, total = F.array_max(probs[1]), A.total(F.transform(probs[1], lambda p: p * 0 + 1))
    by_cosine = sums.select("doc_id", (F.array_max(F.slice("_s", tree.sizes[0] + 1, tree.sizes[1])) / F.sqrt("_square")).alias("cosine"))
    out = df.select("doc_id", top.alias("top"), total.cast("int").alias("classes")).join(by_cosine, "doc_id", "left")
    return rounded(out.withColumn("cosine", F.coalesce("cosine", F.lit(0.0))), 5)


# ---- fits by products and by gradients

@query(recipes.ORACLES["ridge_on_two"])
def ridge_by_products(spark, sf):
    """Ridge by conjugate gradients: the matrix of the features is never formed. Sparse rows of two features."""
    rows = _vectors(spark, sf).withColumn("two", F.struct(F.array(F.lit(0), F.lit(1)).alias("places"), F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double")).alias("values")))
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = models.fit_levels(rows, tree, "two", "ridge").probabilities(rows, "two")
    return rounded(hierarchy.level_argmax(df, tree, probs).select("vec_id", "predicted_l2", F.col("confidence_l2").alias("confidence")), 4)


_LANGS = f"""WITH r AS (SELECT doc_id, lang, unnest(list_distinct({TOKENS})) AS token FROM documents), k AS (SELECT count(*) AS n FROM (SELECT token FROM r GROUP BY 1 HAVING count(*) >= 3))
SELECT lang, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents), 4) AS mean_margin, (SELECT n FROM k)::INT AS features FROM documents GROUP BY 1"""


@query(_LANGS)
def ridge_on_terms(spark, sf):
    """Ridge on the sparse counts of all terms in three documents or more. Its residuals sum to 0 for each class, so a class's
    mean margin is its share of the rows."""
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    how = features.Features("count", min_df=3, max_df=1.0, most=None, binary=True)
    terms = sparse.term_table(docs, "doc_id", "text", how)
    rows = io.stored(sparse.sparse_rows(docs, "doc_id", "text", how, terms).drop("text"), "rows")  # each step reads them
    tree = hierarchy.Tree.fit(docs, ["lang"])
    own = models.fit_levels(rows, tree, "features", "ridge", alpha=10.0)
    n = len(own.models[0].weights[0])
    cells = tree.encode(rows).select(F.posexplode(own.models[0].margins("features")).alias("c", "m"), "code_lang")
    out = cells.groupBy("c").agg(F.count_if(F.col("c") == F.col("code_lang")).alias("rows"), F.avg("m").alias("mean_margin"))
    return rounded(out.select(tree.decode(F.col("c"), 0).alias("lang"), "rows", "mean_margin", F.lit(n).alias("features")), 4)


@query()
def joint_network(spark, sf):
    """One network with a head a level on `embeddings`; tests hold its gradient and its forward pass against plain ones."""
    from taxolith.operators import network

    rows = _vectors(spark, sf)
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = network.fit_network(rows, tree, "embedding", hidden=32, steps=25).probabilities(rows, "embedding")
    return rounded(hierarchy.predictions(df, tree, probs, prefixes=False).select("vec_id", "predicted_l1", "predicted_l2", "confidence"), 4)


# ---- the tree as prefixes, fingerprints, samples, spelling

_TREE = f"""WITH v AS (SELECT vec_id, embedding, (label // 5)::INT::VARCHAR AS l1, (label // 2)::INT::VARCHAR AS l2, label::VARCHAR AS l3 FROM embeddings), q1 AS ({_softmax_sql('l1')}), q2 AS ({_softmax_sql('l2')}), q3 AS ({_softmax_sql('l3')}),
t AS (SELECT *, dense_rank() OVER (ORDER BY l1) AS k1, dense_rank() OVER (ORDER BY l2) AS k2, dense_rank() OVER (ORDER BY l3) AS k3, row_number() OVER (ORDER BY l1, l2, l3) - 1 AS path FROM (SELECT DISTINCT l1, l2, l3 FROM v)),
x AS (SELECT q1.vec_id, t.*, greatest(q1.p[k1], 1e-12) AS a, greatest(q2.p[k2], 1e-12) AS b, greatest(q3.p[k3], 1e-12) AS c FROM q1 JOIN q2 USING (vec_id) JOIN q3 USING (vec_id), t),
y AS (SELECT *, a * b * c AS free, a / sum(a) OVER (PARTITION BY vec_id, ones) * b / twos * c / threes AS shared FROM
 (SELECT *, 1 AS ones, sum(b) FILTER (first_b) OVER (PARTITION BY vec_id, l1) AS twos, sum(c) OVER (PARTITION BY vec_id, l1, l2) AS threes, sum(a) FILTER (first_a) OVER (PARTITION BY vec_id) AS roots FROM
  (SELECT *, row_number() OVER (PARTITION BY vec_id, l1 ORDER BY path) = 1 AS first_a, row_number() OVER (PARTITION BY vec_id, l1, l2 ORDER BY path) = 1 AS first_b FROM x)))"""


def _levelled(spark, sf):
    """The vectors under a tree of three levels, in which a label of the second may have one or two of the third."""
    rows = read(spark, sf, "embeddings").select("vec_id", "embedding", *[F.floor(F.col("label") / k).cast("int").cast("string").alias(c) for c, k in (("l1", 5), ("l2", 2), ("l3", 1))])
    tree = hierarchy.Tree.fit(rows, ["l1", "l2", "l3"])
    df, probs = models.fit_levels(rows, tree, "embedding", "centroid").probabilities(rows, "embedding")
    return df, tree, probs


def _three(spark, sf, mode: str):
    df, tree, probs = _levelled(spark, sf)
    out = hierarchy.trie_paths(df, tree, probs, mode, 3).select("vec_id", F.posexplode("paths").alias("place", "x"), "n_scored")
    return rounded(out.select("vec_id", (F.col("place") + 1).alias("place"), F.col("x.path").alias("path"), F.col("x.probability").alias("probability"), F.col("x.evidence").alias("evidence"), (F.col("n_scored") <= 2 * 10 + 8).alias("bounded")), 5)


def _three_sql(score: str) -> str:
    return f"""{_TREE} SELECT vec_id, place::INT AS place, path::INT AS path, round({score} / total, 5) AS probability, round({score}, 5) AS evidence, true AS bounded
FROM (SELECT *, sum({score}) OVER (PARTITION BY vec_id) AS total, row_number() OVER (PARTITION BY vec_id ORDER BY {score} DESC, path) AS place FROM y) WHERE place <= 3"""


@query(_three_sql("free"))
def trie_independent(spark, sf):
    """The three best paths by a walk over the tree's prefixes that leaves out what cannot be among them."""
    return _three(spark, sf, "independent")


@query(_three_sql("(a / roots * b / twos * c / threes)"))
def trie_conditional(spark, sf):
    return _three(spark, sf, "conditional")


@query("SELECT count(*) AS rows, (sum(('0x' || substr(sha1(length(id) || ':' || id), 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS fingerprint FROM (SELECT DISTINCT doc_id::VARCHAR AS id FROM labels WHERE toxic = 1)")
def id_fingerprint(spark, sf):
    """The fingerprint of a set of excluded keys; repeats and blanks around them do not count."""
    ids = read(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"))
    return splits.id_fingerprint(ids.unionByName(ids))


@query("SELECT doc_id, ('0x' || substr(sha1('42|' || doc_id), 1, 16))::UBIGINT % 1000000 < 200000 AS held FROM documents")
def plain_split(spark, sf):
    """Rows held out by the hash of their key alone, without a label and without a shuffle."""
    train, held = splits.split(read(spark, sf, "documents").select("doc_id"), "doc_id", share=0.2)
    return train.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True)))


@query("SELECT doc_id, lang FROM documents ORDER BY sha1('42|' || doc_id), doc_id LIMIT 50")
def sampled_rows(spark, sf):
    return filters.sampled(read(spark, sf, "documents"), "doc_id", 50).select("doc_id", "lang")


@query("""WITH w AS (SELECT p_partkey, regexp_replace(upper(p_name), '\\s+', ' ', 'g') AS t FROM part)
SELECT p_partkey, trim(regexp_replace(array_to_string(list_transform(string_split(t, ' '), lambda x: CASE x WHEN 'STEEL' THEN 'STEAL' WHEN 'RED' THEN '' WHEN 'STEAL' THEN 'COPPER' ELSE x END), ' '), '\\s+', ' ', 'g')) AS text FROM w""")
def spelling(spark, sf):
    """A two-column file of spellings, one of them with nothing to put in its place, in one pass: no result is put right again."""
    path = _folder(spark, "spelling")
    rows = spark.createDataFrame([("steel", "steal"), ("steal", "copper"), ("red", None)], "find string, replace string")
    rows.write.option("header", True).csv(path)
    found = io.read_pairs(spark, path, blank_to=True)
    text = T.expand(F.regexp_replace(F.upper("p_name"), r"\s+", " "), found)
    return read(spark, sf, "part").select("p_partkey", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


@query("SELECT doc_id, fold, CASE WHEN fold = 2 THEN 0 ELSE 1 END AS trained, lang IN (SELECT lang FROM d WHERE fold <> 2) AS winnable FROM (SELECT doc_id, lang, fold FROM d) WHERE fold = 2".replace("FROM d", f"FROM (SELECT doc_id, CASE WHEN {HELD} = 2 AND doc_id % 7 = 0 THEN 'only here' ELSE lang END AS lang, {HELD} AS fold FROM documents)"))
def unseen_classes(spark, sf):
    """Held-out rows of a class that the training rows lack: they stay and are marked."""
    docs = splits.id_hash_fold(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    docs = docs.withColumn("lang", F.when((F.col("fold") == 2) & (F.col("doc_id") % 7 == 0), "only here").otherwise(F.col("lang")))
    out, _, _ = crossval.recipe_fold(docs, 2, "doc_id", "text", ["lang"], features.Features("count", min_df=3, max_df=1.0, most=None, binary=True))
    return out.select("doc_id", "fold", F.lit(0).alias("trained"), "winnable")
