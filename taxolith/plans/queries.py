"""The registered queries of the catalogue engine, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.functions import text as T
from taxolith.functions import tokens as N
from taxolith.functions import word_lists
from taxolith.operators import ambiguity, calibration, cleaning, evaluation, features, filters, hierarchy, lookup, models, reports, splits, taxonomy, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def key_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
HELD = "(('0x' || substr(sha1('0|' || doc_id), 1, 16))::UBIGINT % 5)::INT"


# ---- text and filters

@query(f"SELECT doc_id, {key_sql('text')} AS text_key FROM documents")
def key_normalise(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.text_key(F.col("text")).alias("text_key"))


@query("""SELECT doc_id, CASE WHEN lang IS NULL OR lower(trim(lang)) IN ('nan','none','null','na','n/a','<na>','nat','nil','#n/a') THEN '' ELSE lang END AS lang,
 CASE WHEN source = 'src3' THEN '' ELSE source END AS source FROM documents""")
def blank_nulls(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("source") == "src3", " NaN ").otherwise(F.col("source")).alias("source"))
    return filters.blank_out_nulls(docs, ["lang", "source"])


@query("SELECT 'source' AS \"column\", count(*) FILTER (source = 'src3') AS n FROM documents UNION ALL SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents")
def null_counts(spark, sf):
    docs = read(spark, sf, "documents").select("lang", F.when(F.col("source") == "src3", "None").otherwise(F.col("source")).alias("source"))
    return filters.null_counts(docs, ["source", "lang"])


@query("SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND lang NOT IN ('', 'nan', 'None') AND source <> 'src7'")
def drop_null_rows(spark, sf):
    docs = read(spark, sf, "documents").withColumn("source", F.when(F.col("source") == "src7", "nan").otherwise(F.col("source")))
    return filters.drop_null_rows(docs, "text", ["lang", "source"]).select("doc_id", "lang", "source")


@query(r"""WITH t AS (SELECT p_partkey, p_name, regexp_replace(p_brand, '\s+', '', 'g') AS b, regexp_replace(p_type, '\s+', '', 'g') AS y FROM part)
SELECT p_partkey, concat_ws(' ', 'VND_' || b, CASE WHEN length(y) >= 2 THEN 'T2_' || y[1:2] END, CASE WHEN length(y) >= 4 THEN 'T4_' || y[1:4] END,
 trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS text FROM t""")
def markers(spark, sf):
    text = T.with_markers(F.col("p_name"), [T.marker(F.col("p_brand"), "VND_"), T.marker(F.col("p_type"), "T", (2, 4))])
    return read(spark, sf, "part").select("p_partkey", text.alias("text"))


_COLOURS = T.whole_word([c.upper() for c in word_lists.COLORS])


@query(rf"""WITH a AS (SELECT p_partkey, regexp_replace(regexp_replace(upper(coalesce(p_name, '') || ' ' || p_size || ' x 4 by' || p_size || ' mm'), '\bhttps?://\S+\b', '', 'g'), '[^\w\s/\-\.]', '', 'g') AS x FROM part),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '{_COLOURS}', ' ', 'g'), '(\d)\s*BY\s*(\d)', '\1X\2', 'g'), '(\d)\s*X\s*(\d)', '\1X\2', 'g'), '\b(\d+)\s*(IN|FT|MM|CM)\b', '\1\2', 'g') AS x FROM a)
SELECT p_partkey, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM b""")
def light_clean(spark, sf):
    """All of the light recipe, over names with their sizes. SQL has no look-behind: it takes one mark after the other, as
    a digit may stand between two."""
    text = F.concat(F.coalesce("p_name", F.lit("")), F.lit(" "), F.col("p_size").cast("string"), F.lit(" x 4 by"), F.col("p_size").cast("string"), F.lit(" mm"))
    return read(spark, sf, "part").select("p_partkey", T.light_clean(text, [word_lists.COLORS]).alias("text"))


@query()
def description_clean(spark, sf):
    recipe = cleaning.Cleaner(upper=True, expansions={"STEEL": "STAINLESS STEEL"})
    return read(spark, sf, "part").select("p_partkey", recipe.column(F.concat_ws(" ", "p_name", F.lit("1/2X3 10 FT W/ XL"), "p_size")).alias("text"))


@query("SELECT doc_id, CASE WHEN length(w) > 2 AND NOT regexp_matches(w, '\\d') AND w IN (SELECT lower(unnest(regexp_extract_all(text, '\\w+'))) FROM benchmark) THEN 1 ELSE 0 END AS first_word_real "
       "FROM (SELECT doc_id, lower(trim(coalesce(regexp_extract(text, '\\S+'), ''), '.,;:!?\"''()[]{}')) AS w FROM documents)")
def first_word_flag(spark, sf):
    known = read(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("word"))
    return cleaning.with_first_word_flag(read(spark, sf, "documents"), "text", known).select("doc_id", "first_word_real")


@query("SELECT doc_id, source FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def blacklist(spark, sf):
    bad = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return filters.drop_ids(read(spark, sf, "documents"), bad, "doc_id").select("doc_id", "source")


@query("SELECT count(*) AS removed_rows, count(DISTINCT doc_id) AS matched_ids, 0::BIGINT AS unmatched_ids FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)")
def blacklist_report(spark, sf):
    bad = read(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return filters.drop_report(read(spark, sf, "documents"), bad, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) * 8 >= (SELECT count(*) FROM documents))")
def rare_classes(spark, sf):
    docs = read(spark, sf, "documents")
    return filters.drop_rare_classes(docs, "lang", -(-docs.count() // 8)).select("doc_id", "source")


@query("SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_type, p_brand, p_size) AS n FROM part) WHERE n >= 2")
def rare_paths(spark, sf):
    return filters.drop_rare_paths(read(spark, sf, "part"), ["p_type", "p_brand", "p_size"]).select("p_partkey")


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem")
def duplicate_ids(spark, sf):
    return filters.duplicate_ids(read(spark, sf, "lineitem"), "l_orderkey")


# ---- tokens and features

@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def token_lists(spark, sf):
    t = N.tokenize(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


_GRAMS = f"(SELECT doc_id, lang, t, list_concat(t, [t[i] || ' ' || t[i + 1] for i in range(1, greatest(len(t), 1))]) AS g FROM (SELECT doc_id, lang, {TOKENS} AS t FROM documents))"
_COUNTS = f"(SELECT ngram, count(*) AS doc_count, count(DISTINCT lang) AS n_classes FROM (SELECT lang, unnest(list_distinct(g)) AS ngram FROM {_GRAMS}) GROUP BY 1)"


@query(f"SELECT ngram, len(string_split(ngram, ' '))::INT AS n, doc_count, n_classes FROM {_COUNTS} WHERE doc_count >= 3")
def ngram_counts(spark, sf):
    return tokens.ngram_counts(read(spark, sf, "documents"), "text", "lang", 1, 2, min_count=3)


@query(f"SELECT threshold::INT AS threshold, count(*) FILTER (doc_count >= threshold) AS kept, quantile_cont(n_classes, 0.5) FILTER (doc_count >= threshold) AS median_classes, round(count(*) FILTER (doc_count >= threshold) / count(*), 6) AS share FROM {_COUNTS}, (SELECT unnest([1, 2, 5, 20]) AS threshold) GROUP BY 1")
def token_report(spark, sf):
    return rounded(tokens.token_report(tokens.ngram_counts(read(spark, sf, "documents"), "text", "lang", 1, 2), [1, 2, 5, 20]))


_TRAIN = f"SELECT doc_id, lang, text, {HELD} AS fold FROM documents"
_INDEX = f"SELECT token, df, (row_number() OVER (ORDER BY df DESC, token) + 1)::INT AS index FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS token FROM ({_TRAIN}) WHERE fold <> 0) GROUP BY 1 HAVING count(*) >= 2 ORDER BY df DESC, token LIMIT 16000)"


def _by_fold(spark, sf):
    docs = splits.id_hash_fold(read(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    return docs.where("fold <> 0"), docs.where("fold = 0")


@query(_INDEX)
def vocabulary(spark, sf):
    return tokens.token_index(_by_fold(spark, sf)[0], "text")


@query(f"""WITH v AS ({_INDEX}), h AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS p FROM documents),
e AS (SELECT doc_id, string_agg(index::VARCHAR, ' ' ORDER BY p) AS ids FROM h JOIN v USING (token) GROUP BY 1)
SELECT doc_id, coalesce(ids, '1') AS ids FROM documents LEFT JOIN e USING (doc_id)""")
def encoded_texts(spark, sf):
    """All splits by the training rows' vocabulary."""
    train, held = _by_fold(spark, sf)
    ids = tokens.encoded(train.unionByName(held), "doc_id", "text", tokens.token_index(train, "text"))
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(f"WITH v AS ({_INDEX}) SELECT round(avg(CASE WHEN v.token IS NULL THEN 1 ELSE 0 END), 6) AS oov_rate FROM (SELECT unnest({TOKENS}) AS token FROM ({_TRAIN}) WHERE fold = 0) h LEFT JOIN v USING (token)")
def oov(spark, sf):
    train, held = _by_fold(spark, sf)
    return rounded(tokens.oov_rate(held, "text", tokens.token_index(train, "text")))


@query(f"""WITH c AS (SELECT token FROM (SELECT unnest(list_distinct({TOKENS})) AS token FROM ({_TRAIN}) WHERE fold <> 0) GROUP BY 1 HAVING count(*) >= 5),
h AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS p FROM documents)
SELECT doc_id, coalesce(k, '') AS text FROM documents LEFT JOIN (SELECT doc_id, string_agg(token, ' ' ORDER BY p) AS k FROM h SEMI JOIN c USING (token) GROUP BY 1) USING (doc_id)""")
def pruned_texts(spark, sf):
    """All splits pruned by the training rows' counts."""
    train, held = _by_fold(spark, sf)
    train, (held,), _ = tokens.drop_rare_tokens(train, [held], "doc_id", "text", 5)
    return train.unionByName(held).select("doc_id", "text")


_TF = f"(SELECT doc_id, feature, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS feature FROM documents) GROUP BY 1, 2)"
_DF = f"(SELECT feature, count(*) AS df, sum(tf) AS total FROM {_TF} GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM documents) ORDER BY total DESC, feature LIMIT 16000)"
_WEIGHT = f"(SELECT doc_id, feature, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM {_TF} JOIN {_DF} USING (feature))"


@query(f"SELECT doc_id, feature, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM {_WEIGHT}")
def tfidf(spark, sf):
    return rounded(features.fit_transform(read(spark, sf, "documents"), [], "doc_id", "text", features.Features())[0])


_FOLD = f"(SELECT doc_id, CASE WHEN contains(x, ' ') THEN array_to_string(list_sort(string_split(x, ' ')), ' ') ELSE x END AS feature FROM (SELECT doc_id, unnest(g) AS x FROM {_GRAMS}))"


@query(f"SELECT feature, count(DISTINCT doc_id)::DOUBLE AS value, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS share FROM {_FOLD} GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3 ORDER BY value DESC, feature LIMIT 50")
def top_folded_bigrams(spark, sf):
    docs = read(spark, sf, "documents")
    how = features.Features("count", 1, 2, min_df=3, max_df=1.0, most=None, binary=True, fold=True)
    return rounded(features.top_chosen(features.fit_transform(docs, [], "doc_id", "text", how)[2], 50, docs.count()))


@query(f"WITH k AS (SELECT feature, count(DISTINCT doc_id) AS df FROM {_FOLD} GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3) SELECT 'folded' AS name, count(*) AS features, round(sum(df) / (count(*) * (SELECT count(*) FROM documents)), 6) AS density, round(sum(df) / (SELECT count(*) FROM documents), 6) AS mean_nnz FROM k")
def feature_sweep(spark, sf):
    how = features.Features("count", 1, 2, min_df=3, max_df=1.0, most=None, binary=True, fold=True)
    return rounded(features.sweep(read(spark, sf, "documents"), "doc_id", "text", {"folded": how}))


_VEC = ", ".join(f"(ascii(substr(token, {k}, 1)) % 17) / 17.0 - 0.5" for k in (1, 2, 3, 4))
_LONG = f"(SELECT doc_id, unnest({TOKENS}) AS token FROM documents)"


@query(f"""WITH m AS (SELECT doc_id, {', '.join(f"avg((ascii(substr(token, {k}, 1)) % 17) / 17.0 - 0.5) AS m{k}" for k in (1, 2, 3, 4))} FROM {_LONG} GROUP BY 1),
n AS (SELECT *, sqrt(m1*m1 + m2*m2 + m3*m3 + m4*m4) AS s FROM m)
SELECT d.doc_id, {', '.join(f"round(coalesce(CASE WHEN s > 0 THEN m{k} / s ELSE m{k} END, 0.0), 6) AS v{k}" for k in (1, 2, 3, 4))} FROM documents d LEFT JOIN n USING (doc_id)""")
def pooled_documents(spark, sf):
    docs = read(spark, sf, "documents")
    own = docs.select(F.explode(N.tokenize(F.col("text"))).alias("token")).distinct()
    vectors = own.select("token", F.array(*[F.ascii(F.substring("token", k, 1)) % 17 / 17.0 - 0.5 for k in (1, 2, 3, 4)]).alias("vector"))
    out = features.document_vectors(docs, "doc_id", "text", vectors, 4, normalise=True)
    return rounded(out.select("doc_id", *[F.get("vector", k).alias(f"v{k + 1}") for k in range(4)]))


# ---- reports

@query("""WITH l AS (SELECT 'p_type' AS level, p_type AS label FROM part UNION ALL SELECT 'p_brand', p_brand FROM part), c AS (SELECT level, label, count(*) AS n FROM l GROUP BY 1, 2)
SELECT level, count(*) AS n_classes, min(n) AS min_rows, quantile_cont(n, 0.5) AS median_rows, max(n) AS max_rows, count(*) FILTER (n < 10) AS under_10 FROM c GROUP BY 1""")
def class_distribution(spark, sf):
    return reports.class_distribution(read(spark, sf, "part"), ["p_type", "p_brand"])


@query("""WITH l AS (SELECT p_type AS c, 'p_brand' AS col, p_brand AS v FROM part UNION ALL SELECT p_type, 'p_size', p_size::VARCHAR FROM part), a AS (SELECT col, v, count(*) AS n, count(DISTINCT c) AS k FROM l GROUP BY 1, 2)
SELECT col AS "column", 1.0::DOUBLE AS present, count(*) AS n_distinct, round(sum(n) / count(*), 6) AS rows_per_value, quantile_cont(k, 0.5) FILTER (n >= 50) AS median_categories,
 round(coalesce(sum(n) FILTER (n >= 50), 0) / sum(n), 6) AS rows_covered FROM a GROUP BY 1""")
def column_usefulness(spark, sf):
    return rounded(reports.column_usefulness(read(spark, sf, "part"), ["p_brand", "p_size"], "p_type"))


@query("SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_categories FROM lineitem GROUP BY 1")
def vendor_concentration(spark, sf):
    return reports.concentration(read(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("""WITH v AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.99) AS q99 FROM v),
c AS (SELECT count(*) FILTER (n >= 50) AS a, count(*) FILTER (n >= q90) AS b, count(*) FILTER (n >= 10) AS c, count(*) FILTER (n >= 5) AS d FROM v, q)
SELECT round(q50, 6) AS q50, round(q75, 6) AS q75, round(q90, 6) AS q90, round(q99, 6) AS q99, round(CASE WHEN a >= 20 THEN 50 WHEN b >= 20 THEN q90 WHEN c >= 20 THEN 10 WHEN d >= 20 THEN 5 ELSE 1 END::DOUBLE, 6) AS min_rows FROM q, c""")
def vendor_quantiles(spark, sf):
    return rounded(reports.quantiles(reports.concentration(read(spark, sf, "lineitem"), "l_suppkey", "l_partkey")))


_PFOLD = "(SELECT *, (('0x' || substr(sha1('0|' || p_partkey), 1, 16))::UBIGINT % 5)::INT AS fold FROM part)"


@query(f"SELECT round(avg(CASE WHEN p_size IN (SELECT p_size FROM {_PFOLD} WHERE fold <> 0) THEN 1 ELSE 0 END), 6) AS seen_share FROM {_PFOLD} WHERE fold = 0")
def held_out_coverage(spark, sf):
    part = splits.id_hash_fold(read(spark, sf, "part"), "p_partkey")
    return rounded(reports.held_out_coverage(part.where("fold <> 0"), part.where("fold = 0"), "p_size"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def value_counts(spark, sf):
    return reports.value_counts(read(spark, sf, "part"), "p_name")


# ---- taxonomy, folds, fingerprints

_NODES = """(SELECT 'r' || r_regionkey AS id, NULL AS parent_id, 1 AS level, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 2, n_name FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 3, c_name FROM customer)"""


def _nodes(spark, sf):
    part = lambda t, i, p, level, name: read(spark, sf, t).select(F.concat(F.lit(i[0]), F.col(i[1]).cast("string")).alias("id"), (F.concat(F.lit(p[0]), F.col(p[1]).cast("string")) if p else F.lit(None).cast("string")).alias("parent_id"), F.lit(level).alias("level"), F.col(name).alias("name"), F.lit(1).alias("current"))
    nodes = part("region", ("r", "r_regionkey"), None, 1, "r_name").unionByName(part("nation", ("n", "n_nationkey"), ("r", "n_regionkey"), 2, "n_name"))
    return nodes.unionByName(part("customer", ("c", "c_custkey"), ("n", "c_nationkey"), 3, "c_name"))


@query(f"""WITH n AS {_NODES} SELECT a.id AS l1_id, a.name AS l1_name, b.id AS l2_id, b.name AS l2_name, c.id AS l3_id, c.name AS l3_name
FROM n a LEFT JOIN n b ON b.parent_id = a.id AND b.level = 2 LEFT JOIN n c ON c.parent_id = b.id AND c.level = 3 WHERE a.level = 1""")
def taxonomy_levels(spark, sf):
    return taxonomy.level_columns(_nodes(spark, sf), 3)


@query("""SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def attached_names(spark, sf):
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("r_regionkey").alias("l1"), F.col("n_nationkey").alias("l2"), "n_name", "r_name")
    customers = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("l1"), F.col("n_nationkey").alias("l2"))
    rows = read(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "l1", "l2")
    return taxonomy.attach_names(rows, names, ["l1", "l2"], ["n_name", "r_name"]).select("o_orderkey", "n_name", "r_name")


@query("""WITH i AS (SELECT o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P')), s AS (SELECT o_orderkey, min(s_name) AS s_name FROM i JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING max((s_acctbal > 0)::INT) = 1) SELECT o_orderkey, l_suppkey, s_name FROM i LEFT JOIN s USING (o_orderkey)""")
def items_with_warehouse(spark, sf):
    sku = read(spark, sf, "orders").select(F.col("o_orderkey").alias("product_no"))
    orders = read(spark, sf, "orders")
    item = read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    item = item.select(F.col("l_orderkey").alias("product_no"), F.lit(1).alias("current"), F.when(F.col("o_orderstatus").isin("F", "P"), 1).otherwise(2).alias("cono"), "l_suppkey")
    house = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", (F.col("s_acctbal") > 0).cast("int").alias("warehouse_current"))
    stock = item.join(house, "l_suppkey").groupBy("product_no", "cono").agg(F.min("s_name").alias("s_name"), F.max("warehouse_current").alias("warehouse_current"))
    return taxonomy.current_items(sku, item, stock).select(F.col("product_no").alias("o_orderkey"), "l_suppkey", "s_name")


@query(f"SELECT doc_id, {HELD} AS fold FROM documents")
def folds(spark, sf):
    return splits.id_hash_fold(read(spark, sf, "documents"), "doc_id").select("doc_id", "fold")


@query("SELECT lang, count(*) AS n_rows, greatest(1, round(count(*) * 0.1))::BIGINT AS n_held FROM documents GROUP BY 1")
def stratified_split(spark, sf):
    train, held = splits.split(read(spark, sf, "documents"), "doc_id", "lang")
    both = train.withColumn("h", F.lit(0)).unionByName(held.withColumn("h", F.lit(1)))
    return both.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("h").cast("long").alias("n_held"))


_ROW = "coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(length(text) || ':' || text, '-') || coalesce(length(lang) || ':' || lang, '-')"


@query(f"SELECT count(*) AS rows, (sum(('0x' || substr(sha1({_ROW}), 1, 16))::UBIGINT::HUGEINT) % 18446744073709551616)::VARCHAR AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return splits.data_fingerprint(read(spark, sf, "documents"), ["doc_id", "text", "lang"])


# ---- ambiguity and lookup

def _bound_sql(label: str, level: str, table: str = "part", text: str = "p_name") -> str:
    return f"""SELECT '{level}' AS level, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, sum(CASE WHEN n >= 2 THEN n ELSE 0 END)::BIGINT AS n_shared_rows, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::BIGINT AS n_ambiguous_rows,
 count(*) FILTER (k > 1) AS n_ambiguous_groups, sum(n - m)::BIGINT AS n_unwinnable, round(1 - sum(n - m) / sum(n), 6) AS bound, round(sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n), 6) AS coverage, round(sum(CASE WHEN k > 1 THEN n ELSE 0 END) / sum(n), 6) AS ambiguous_share
 FROM (SELECT key, sum(c) AS n, max(c) AS m, count(*) AS k FROM (SELECT {key_sql(text)} AS key, {label} AS label, count(*) AS c FROM {table} GROUP BY 1, 2) GROUP BY 1)"""


@query(_bound_sql("p_type", "p_type"))
def ambiguity_bound(spark, sf):
    return rounded(ambiguity.report(read(spark, sf, "part"), "p_name", "p_type"))


@query(" UNION ALL ".join((_bound_sql("p_type", "p_type"), _bound_sql("p_brand", "p_brand"), _bound_sql("p_type || '|' || p_brand", "path"))))
def ambiguity_by_level(spark, sf):
    return rounded(ambiguity.by_level(read(spark, sf, "part"), "p_name", ["p_type", "p_brand"]))


@query(_bound_sql("lang", "lang", "documents", "text"))
def ambiguity_of_documents(spark, sf):
    return rounded(ambiguity.report(read(spark, sf, "documents"), "text", "lang"))


@query(f"""WITH p AS (SELECT {key_sql('p_name')} AS key, p_type AS label, count(*) AS n FROM part GROUP BY 1, 2), g AS (SELECT key, sum(n)::BIGINT AS rows, count(*) AS n_labels FROM p GROUP BY 1 HAVING count(*) > 1 ORDER BY rows DESC, n_labels DESC, key LIMIT 20)
SELECT key, rows, n_labels, string_agg(label || ' x' || n, ', ' ORDER BY n DESC, label) AS labels FROM g JOIN p USING (key) GROUP BY 1, 2, 3""")
def ambiguous_examples(spark, sf):
    return ambiguity.examples(read(spark, sf, "part"), "p_name", "p_type")


@query(f"""WITH g AS (SELECT {key_sql('p_name')} AS key, count(DISTINCT p_brand) AS k FROM {_PFOLD} WHERE fold <> 0 GROUP BY 1)
SELECT p_partkey, CASE WHEN k IS NULL THEN 'unseen in training' WHEN k = 1 THEN 'seen, one label' ELSE 'seen, several labels' END AS bucket FROM {_PFOLD} LEFT JOIN g ON key = {key_sql('p_name')} WHERE fold = 0""")
def row_buckets(spark, sf):
    part = splits.id_hash_fold(read(spark, sf, "part"), "p_partkey")
    return ambiguity.with_bucket(part.where("fold = 0"), "p_name", "p_brand", part.where("fold <> 0")).select("p_partkey", "bucket")


_LOOKUP = f"""(SELECT text_key, p_type, p_brand, support, purity FROM (SELECT text_key, p_type, p_brand, sum(n) OVER (PARTITION BY text_key)::BIGINT AS support, n / sum(n) OVER (PARTITION BY text_key) AS purity,
 row_number() OVER (PARTITION BY text_key ORDER BY n DESC, p_type, p_brand) AS r FROM (SELECT {key_sql('p_name')} AS text_key, p_type, p_brand, count(*) AS n FROM {_PFOLD} WHERE fold <> 0 GROUP BY 1, 2, 3)) WHERE r = 1)"""


@query(f"SELECT text_key, p_type, p_brand, support, round(purity, 6) AS purity FROM {_LOOKUP}")
def lookup_fit(spark, sf):
    part = splits.id_hash_fold(read(spark, sf, "part"), "p_partkey")
    return rounded(lookup.fit(part.where("fold <> 0"), "p_name", ["p_type", "p_brand"]))


def _looked(spark, sf):
    part = splits.id_hash_fold(read(spark, sf, "part"), "p_partkey")
    table = lookup.fit(part.where("fold <> 0"), "p_name", ["p_type", "p_brand"])
    return lookup.predict(part.where("fold = 0"), "p_name", table, ["p_type", "p_brand"], 2, 0.01)


_LOOKED = f"(SELECT p.*, coalesce(support >= 2 AND purity >= 0.01, false) AS hit, CASE WHEN support >= 2 AND purity >= 0.01 THEN l.p_type END AS a, CASE WHEN support >= 2 AND purity >= 0.01 THEN l.p_brand END AS b, coalesce(support, 0) AS s, coalesce(purity, 0) AS u FROM {_PFOLD} p LEFT JOIN {_LOOKUP} l ON text_key = {key_sql('p_name')} WHERE fold = 0)"


@query(f"SELECT p_partkey, hit, a AS lookup_p_type, b AS lookup_p_brand, s AS support, round(u, 6) AS purity FROM {_LOOKED}")
def lookup_predict(spark, sf):
    return rounded(_looked(spark, sf).select("p_partkey", "hit", "lookup_p_type", "lookup_p_brand", "support", "purity"))


@query(f"SELECT p_partkey, coalesce(a, 'STANDARD') AS predicted_p_type, CASE WHEN hit THEN 'lookup' ELSE 'model' END AS source, round(CASE WHEN hit THEN u ELSE 0.25 END, 6) AS confidence FROM {_LOOKED}")
def lookup_blend(spark, sf):
    rows = _looked(spark, sf).withColumns({"predicted_p_type": F.lit("STANDARD"), "confidence": F.lit(0.25)})
    return rounded(lookup.blend(rows, ["p_type"]).select("p_partkey", "predicted_p_type", "source", "confidence"))


@query(f"SELECT round(avg(CASE WHEN a = p_type AND b = p_brand THEN 1 ELSE 0 END), 6) AS ceiling, count(*) AS rows FROM {_LOOKED} WHERE s >= 1")
def lookup_ceiling(spark, sf):
    return rounded(lookup.true_ceiling(_looked(spark, sf), ["p_type", "p_brand"]))


_OVER = f"(SELECT *, CASE WHEN s = 0 THEN 'unseen in training' ELSE 'seen' END AS bucket, CASE WHEN a = p_type THEN 1 ELSE 0 END AS r1, CASE WHEN p_type = 'STANDARD' THEN 1 ELSE 0 END AS r2 FROM {_LOOKED})"


@query(f"""SELECT source, coalesce(bucket, 'all') AS bucket, count(*) AS rows, round(avg(r), 6) AS accuracy FROM (SELECT 'lookup' AS source, bucket, r1 AS r FROM {_OVER} UNION ALL SELECT 'constant', bucket, r2 FROM {_OVER}) GROUP BY GROUPING SETS ((source, bucket), (source))""")
def compare_by_bucket(spark, sf):
    rows = _looked(spark, sf).withColumns({"bucket": F.when(F.col("support") == 0, "unseen in training").otherwise("seen"), "constant": F.lit("STANDARD")})
    return rounded(lookup.compare_by_bucket(rows, {"lookup": "lookup_p_type", "constant": "constant"}, "p_type"))


@query(f"""WITH g AS (SELECT {key_sql('p_name')} AS key, count(DISTINCT p_type) AS k, count(*) AS n FROM part GROUP BY 1), r AS (SELECT CASE WHEN n = 1 THEN 'singleton' WHEN k > 1 THEN 'ambiguous' ELSE 'consistent duplicate' END AS bucket, key, p_type, (p_type = 'STANDARD')::INT AS ok FROM part JOIN g ON key = {key_sql('p_name')}),
m AS (SELECT bucket, sum(m) / sum(n) AS bound FROM (SELECT bucket, key, max(c) AS m, sum(c) AS n FROM (SELECT bucket, key, p_type, count(*) AS c FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1)
SELECT bucket, count(*) AS rows, round(count(*) / (SELECT count(*) FROM part), 6) AS share, round(avg(ok), 6) AS accuracy, round(CASE WHEN bucket = 'ambiguous' THEN any_value(bound) WHEN bucket = 'singleton' THEN NULL ELSE 1.0 END, 6) AS ceiling, sum(1 - ok)::BIGINT AS errors, round(sum(1 - ok) / (SELECT sum(1 - ok) FROM r), 6) AS error_share FROM r JOIN m USING (bucket) GROUP BY 1""")
def error_overlap(spark, sf):
    return rounded(ambiguity.error_overlap(read(spark, sf, "part").withColumn("predicted", F.lit("STANDARD")), "p_name", "p_type", "predicted"))


# ---- models, tree scoring, calibration, evaluation: 64-wide vectors, a tree of label div 5 and label

LEVELS = ["l1", "l2"]


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", "embedding", F.floor(F.col("label") / 5).cast("int").cast("string").alias("l1"), F.col("label").cast("string").alias("l2"))


def _scored(spark, sf, mode="independent"):
    rows = _vectors(spark, sf)
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = models.fit_levels(rows, tree, "embedding", "centroid").probabilities(rows, "embedding")
    return hierarchy.predictions(tree.encode(df), tree, probs, mode), tree, probs


def _softmax_sql(level: str) -> str:
    return f"""SELECT vec_id, list(e / t ORDER BY c) AS p FROM (SELECT vec_id, c, e, sum(e) OVER (PARTITION BY vec_id) AS t FROM (SELECT vec_id, c, exp((s - max(s) OVER (PARTITION BY vec_id)) / 0.1) AS e FROM
 (SELECT vec_id, c, list_cosine_similarity(embedding::DOUBLE[], m) AS s FROM v, (SELECT c, list(m ORDER BY i) AS m FROM (SELECT {level} AS c, i, avg(embedding[i]::DOUBLE) AS m FROM v, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1)))) GROUP BY 1"""


_BASE = f"""WITH v AS (SELECT vec_id, embedding, (label // 5)::INT::VARCHAR AS l1, label::VARCHAR AS l2 FROM embeddings), q1 AS ({_softmax_sql('l1')}), q2 AS ({_softmax_sql('l2')}),
k1 AS (SELECT l1 AS n, (row_number() OVER (ORDER BY l1))::INT AS k FROM (SELECT DISTINCT l1 FROM v)), k2 AS (SELECT l2 AS n, l1, (row_number() OVER (ORDER BY l2))::INT AS k FROM (SELECT DISTINCT l1, l2 FROM v)),
s AS (SELECT v.vec_id, v.l1 AS t1, v.l2 AS t2, k2.l1 AS c1, k2.n AS c2, q1.p AS p1, q2.p AS p2, q1.p[k1.k] AS a, q2.p[k2.k] AS b FROM v JOIN q1 USING (vec_id) JOIN q2 USING (vec_id), k2 JOIN k1 ON k1.n = k2.l1),
x AS (SELECT *, ln(greatest(a, 1e-12)) + ln(greatest(b, 1e-12)) AS sc, ln(greatest(a, 1e-12)) + ln(greatest(b, 1e-12)) - ln(sum(greatest(b, 1e-12)) OVER (PARTITION BY vec_id, c1)) AS cond FROM s),
y AS (SELECT *, exp(sc) AS e, exp(sc) / sum(exp(sc)) OVER (PARTITION BY vec_id) AS pr, sum(exp(sc)) OVER (PARTITION BY vec_id, c1) / sum(exp(sc)) OVER (PARTITION BY vec_id) AS m1, row_number() OVER (PARTITION BY vec_id ORDER BY sc DESC, c1, c2) AS r FROM x),
z AS (SELECT *, (SELECT NULL) AS nothing FROM y WHERE r = 1),
mm AS (SELECT vec_id, max(m1) AS mass_1, max(m1) - min(m1) AS margin_1 FROM y GROUP BY 1)"""


@query(_BASE + " SELECT vec_id, round(p1[1], 6) AS p1_0, round(p2[1], 6) AS p2_0, round(list_max(p2), 6) AS p2_max FROM z")
def centroid_probabilities(spark, sf):
    rows = _vectors(spark, sf)
    df, (a, b) = models.fit_levels(rows, hierarchy.Tree.fit(rows, LEVELS), "embedding", "centroid").probabilities(rows, "embedding")
    return rounded(df.select("vec_id", F.get(a, 0).alias("p1_0"), F.get(b, 0).alias("p2_0"), F.array_max(b).alias("p2_max")))


@query("SELECT label::INT // 5 || '' AS l1, label || '' AS l2, count(*) AS n, (dense_rank() OVER (ORDER BY label::INT // 5 || '') - 1)::INT AS c1, (dense_rank() OVER (ORDER BY label || '') - 1)::INT AS c2 FROM embeddings GROUP BY label")
def label_tree(spark, sf):
    tree = hierarchy.Tree.fit(_vectors(spark, sf), LEVELS)
    return tree.table(spark).select(tree.decode(F.col("c1"), 0).alias("l1"), tree.decode(F.col("c2"), 1).alias("l2"), "n", "c1", "c2")


@query(_BASE + " SELECT vec_id, c1 AS predicted_l1, c2 AS predicted_l2, round(pr, 6) AS confidence, round(e, 6) AS path_evidence, round(b, 6) AS level_confidence_l2 FROM z")
def joint_independent(spark, sf):
    return rounded(_scored(spark, sf)[0].select("vec_id", "predicted_l1", "predicted_l2", "confidence", "path_evidence", "level_confidence_l2"))


@query(_BASE + " SELECT vec_id, arg_max(c2, cond) AS predicted_l2, round(max(exp(cond)) / sum(exp(cond)), 6) AS confidence, round(sum(exp(cond)), 6) AS total FROM y GROUP BY 1")
def joint_conditional(spark, sf):
    rows = _vectors(spark, sf)
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = models.fit_levels(rows, tree, "embedding", "centroid").probabilities(rows, "embedding")
    df = hierarchy.path_scores(df, tree, probs, "conditional")
    total = A.total(F.transform("scores", lambda s: F.exp(s)))
    best = F.get(F.lit([tree.classes[1][p[1]] for p in tree.paths]), A.arg_max(F.col("scores")))
    return rounded(df.select("vec_id", best.alias("predicted_l2"), (F.exp(F.array_max("scores")) / total).alias("confidence"), total.alias("total")))


@query(_BASE + " SELECT vec_id, round(mass_1, 6) AS mass_1, round(margin_1, 6) AS margin_1, round(-list_sum([greatest(q, 1e-12) * ln(greatest(q, 1e-12)) for q in p2]), 6) AS entropy FROM z JOIN mm USING (vec_id)")
def prefix_mass_and_entropy(spark, sf):
    return rounded(_scored(spark, sf)[0].select("vec_id", "mass_1", "margin_1", "entropy"))


@query(_BASE + " SELECT 'l1' AS level, round(avg((t1 = c1)::INT), 6) AS accuracy, count(DISTINCT t1) AS n_classes FROM z UNION ALL SELECT 'l2', round(avg((t2 = c2)::INT), 6), count(DISTINCT t2) FROM z")
def per_level_accuracy(spark, sf):
    return rounded(evaluation.per_level(_scored(spark, sf)[0], LEVELS))


@query(_BASE + " SELECT 'level' AS measure, 'l1' AS level, round(avg((t1 = c1)::INT), 6) AS value FROM z UNION ALL SELECT 'level', 'l2', round(avg((t2 = c2)::INT), 6) FROM z UNION ALL SELECT 'prefix', '1', round(avg((t1 = c1)::INT), 6) FROM z UNION ALL SELECT 'prefix', '2', round(avg((t1 = c1 AND t2 = c2)::INT), 6) FROM z UNION ALL SELECT 'path', 'all', round(avg((t1 = c1 AND t2 = c2)::INT), 6) FROM z")
def evaluation_table(spark, sf):
    return rounded(evaluation.evaluate(_scored(spark, sf)[0], LEVELS))


@query(_BASE + " SELECT round(avg((k <= 3)::INT), 6) AS accuracy FROM (SELECT vec_id, t2, c2, row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, c2) AS k FROM y) WHERE t2 = c2")
def top_3_accuracy(spark, sf):
    rows = _vectors(spark, sf)
    tree = hierarchy.Tree.fit(rows, LEVELS)
    df, probs = models.fit_levels(rows, tree, "embedding", "centroid").probabilities(tree.encode(rows), "embedding")
    return rounded(evaluation.top_k(df, probs[1], "code_l2", 3))


@query(_BASE + " SELECT t2 AS actual, c2 AS predicted, count(*) AS count, round(count(*) / (SELECT count(*) FROM z WHERE t2 <> c2), 6) AS error_share FROM z WHERE t2 <> c2 GROUP BY 1, 2 ORDER BY count DESC, actual, predicted LIMIT 20")
def confusions(spark, sf):
    return rounded(evaluation.confusions(_scored(spark, sf)[0], "l2", "predicted_l2"))


_BANDS = "(SELECT least(greatest(len(list_filter([k * 0.1 for k in range(0, 10)], lambda e: b >= e)) - 1, 0), 9)::INT AS band, b, (t2 = c2)::INT AS ok FROM z)"


@query(_BASE + f" SELECT k::INT AS band, count(band) AS rows, round(coalesce(avg(b), (k + 0.5) / 10), 6) AS mean_confidence, round(avg(ok), 6) AS accuracy, round(abs(avg(ok) - avg(b)), 6) AS gap FROM range(0, 10) t(k) LEFT JOIN {_BANDS} ON band = k GROUP BY k")
def reliability(spark, sf):
    table = calibration.reliability(_scored(spark, sf)[0], "level_confidence_l2", evaluation.right("l2", "predicted_l2"))
    return rounded(table.select("band", "rows", "mean_confidence", "accuracy", "gap"))


@query(_BASE + f" SELECT round(sum(n * abs(a - m)) / sum(n), 6) AS ece FROM (SELECT band, count(*) AS n, avg(ok) AS a, avg(b) AS m FROM {_BANDS} GROUP BY 1)")
def calibration_error(spark, sf):
    return rounded(calibration.calibration_error(_scored(spark, sf)[0], "level_confidence_l2", evaluation.right("l2", "predicted_l2")))


_GRID = "(SELECT k / 10.0 AS threshold FROM range(1, 10) t(k))"


@query(_BASE + f" SELECT round(threshold::DOUBLE, 6) AS threshold, count(*) FILTER (b >= threshold) AS n_auto, round(count(*) FILTER (b >= threshold) / count(*), 6) AS coverage, round(avg((t2 = c2)::INT) FILTER (b >= threshold), 6) AS accuracy, count(*) FILTER (b < threshold) AS n_reviewed, count(*) FILTER (b >= threshold AND t2 <> c2) AS errors_auto FROM z, {_GRID} GROUP BY threshold")
def coverage(spark, sf):
    rows = _scored(spark, sf)[0].withColumn("right", evaluation.right("l2", "predicted_l2"))
    return rounded(calibration.coverage_table(rows, "level_confidence_l2", "right", [k / 10 for k in range(1, 10)]))


_LIMITS = "l AS (SELECT depth, min(threshold) FILTER (acc >= 0.95) AS threshold FROM (SELECT depth, threshold, avg(ok) FILTER (c >= threshold) AS acc FROM (SELECT 1 AS depth, p1[(SELECT k FROM k1 WHERE n = c1)] AS c, (t1 = c1)::INT AS ok FROM z UNION ALL SELECT 2, b, (t2 = c2)::INT FROM z), (SELECT round(0.05 + 0.01 * k, 3)::DOUBLE AS threshold FROM range(0, 95) t(k)) GROUP BY 1, 2) GROUP BY 1)"


@query(_BASE + ", " + _LIMITS + " SELECT depth, round(threshold, 6) AS threshold FROM l")
def level_thresholds(spark, sf):
    return rounded(calibration.level_thresholds(_scored(spark, sf)[0], LEVELS))


_CASCADE = ", " + _LIMITS + ", w AS (SELECT *, CASE WHEN b >= (SELECT threshold FROM l WHERE depth = 2) THEN 2 WHEN p1[(SELECT k FROM k1 WHERE n = c1)] >= (SELECT threshold FROM l WHERE depth = 1) THEN 1 ELSE 0 END AS d FROM z)"


@query(_BASE + _CASCADE + " SELECT k::INT AS assigned_depth, count(d) AS rows, round(count(d) / (SELECT count(*) FROM w), 6) AS share, round(avg(CASE WHEN k = 1 THEN (t1 = c1)::INT WHEN k = 2 THEN (t2 = c2)::INT END), 6) AS accuracy FROM range(0, 3) t(k) LEFT JOIN w ON d = k GROUP BY k")
def cascade_report(spark, sf):
    rows = _scored(spark, sf)[0]
    limits = calibration.as_map(calibration.level_thresholds(rows, LEVELS))
    return rounded(calibration.cascade_report(calibration.cascade_by_level(rows, LEVELS, limits), LEVELS))


@query(_BASE + _CASCADE + " SELECT d::INT AS assigned_depth, count(*) AS rows, round(count(*) / (SELECT count(*) FROM w), 6) AS share, round(avg(CASE d WHEN 2 THEN b WHEN 1 THEN p1[(SELECT k FROM k1 WHERE n = c1)] END), 6) AS mean_confidence FROM w GROUP BY 1")
def score_summary(spark, sf):
    """The flagship: vectors to level probabilities, paths that exist, thresholds, assignment at the deepest level earned."""
    rows = _scored(spark, sf)[0]
    limits = calibration.as_map(calibration.level_thresholds(rows, LEVELS))
    return rounded(evaluation.score_summary(calibration.cascade_by_level(rows, LEVELS, limits)))


@query(_BASE + " SELECT 'independent' AS run, round(avg((t1 = c1)::INT), 6) AS l1, round(avg((t2 = c2)::INT), 6) AS l2, round(avg((t1 = c1 AND t2 = c2)::INT), 6) AS path FROM z UNION ALL SELECT 'argmax', round(avg((t1 = a1)::INT), 6), round(avg((t2 = a2)::INT), 6), round(avg((t1 = a1 AND t2 = a2)::INT), 6) FROM (SELECT vec_id, any_value(t1) AS t1, any_value(t2) AS t2, arg_max(c1, a) AS a1, arg_max(c2, b) AS a2 FROM y GROUP BY 1)")
def compare_modes(spark, sf):
    return rounded(evaluation.compared({"independent": _scored(spark, sf)[0], "argmax": _scored(spark, sf, "argmax")[0]}, LEVELS))


@query()
def temperature(spark, sf):
    df, tree, probs = _scored(spark, sf)
    rows = models.fit_levels(_vectors(spark, sf), tree, "embedding", "centroid").probabilities(tree.encode(_vectors(spark, sf)), "embedding")[0]
    logits = rows.withColumn("z", F.transform("p_l2", lambda x: F.log(F.greatest(x, F.lit(1e-12)))))
    t = calibration.fit_temperature(logits, "z", "code_l2")
    return rounded(calibration.with_temperature(logits, "z", t, "p").select("vec_id", F.array_max("p").alias("confidence"), F.lit(t).alias("temperature")))


@query()
def isotonic(spark, sf):
    rows = _scored(spark, sf)[0]
    model = calibration.fit_isotonic(rows, "level_confidence_l2", evaluation.right("l2", "predicted_l2"))
    own = _vectors(spark, sf)
    df, probs = models.fit_levels(own, hierarchy.Tree.fit(own, LEVELS), "embedding", "centroid").probabilities(own, "embedding")
    return rounded(calibration.with_isotonic(df, probs[1], model).select("vec_id", F.array_max(probs[1]).alias("confidence"), A.total(F.col(probs[1])).alias("total")))


def _by_model(name: str, **how) -> Callable:
    def run(spark, sf):
        rows = _vectors(spark, sf)
        tree = hierarchy.Tree.fit(rows, LEVELS)
        df, probs = models.fit_levels(rows, tree, "embedding", name, **how).probabilities(rows, "embedding")
        return rounded(hierarchy.level_argmax(df, tree, probs).select("vec_id", "predicted_l1", "predicted_l2", "confidence_l2"), 4)

    run.__name__ = f"model_{name}"
    return query()(run)


for _name in ("lda", "ridge", "gaussian_nb", "logistic", "perceptron"):
    _by_model(_name)


@query()
def oof_accuracy(spark, sf):
    from taxolith.plans import crossval

    rows = _vectors(spark, sf)
    oof = crossval.out_of_fold(splits.id_hash_fold(rows, "vec_id", out="f"), "vec_id", "embedding", LEVELS, 5, fold="f")
    tree = hierarchy.Tree.fit(rows, LEVELS)
    scored = hierarchy.level_argmax(oof, tree, ["p_l1", "p_l2"])
    return rounded(evaluation.by_fold(scored, evaluation.right("l2", "predicted_l2")))


def _bayes_sql(label: str) -> str:
    return f"""SELECT doc_id, c, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY doc_id) AS p FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM
 (SELECT d.doc_id, b.c, prior + coalesce(sum(ln(coalesce(n, 0) + 1.0) + low) FILTER (h.token IS NOT NULL), 0) AS s FROM d CROSS JOIN
  (SELECT c, ln(r + 1.0) - ln(sum(r) OVER () + count(*) OVER ()) AS prior, -ln(coalesce(t, 0) + (SELECT count(DISTINCT token) FROM h)) AS low FROM (SELECT {label} AS c, count(*) AS r FROM d GROUP BY 1) LEFT JOIN (SELECT {label} AS c, count(*) AS t FROM h JOIN d USING (doc_id) GROUP BY 1) USING (c)) b
  LEFT JOIN h USING (doc_id) LEFT JOIN (SELECT {label} AS c, token, count(*) AS n FROM h JOIN d USING (doc_id) GROUP BY 1, 2) w ON w.c = b.c AND w.token = h.token GROUP BY d.doc_id, b.c, prior))"""


@query(f"""WITH d AS (SELECT doc_id, text, lang AS a, lang || '/' || CASE WHEN source < 'src2' THEN 'low' ELSE 'high' END AS b FROM documents), r AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM d),
h AS (SELECT * FROM r SEMI JOIN (SELECT token FROM r GROUP BY 1 HAVING count(*) >= 3 AND count(*) <= 0.95 * (SELECT count(*) FROM d) ORDER BY count(*) DESC, token LIMIT 5000) USING (token)), p1 AS ({_bayes_sql("a")}), p2 AS ({_bayes_sql("b")}),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln(greatest(pa, 1e-12)) + ln(greatest(pb, 1e-12)) DESC, a, b) AS place FROM (SELECT p1.doc_id, p1.c AS a, p2.c AS b, p1.p AS pa, p2.p AS pb FROM p1 JOIN p2 USING (doc_id) WHERE p1.c = string_split(p2.c, '/')[1])),
k AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1)
SELECT doc_id, CASE WHEN depth >= 1 THEN z.a END AS predicted_a, CASE WHEN depth >= 2 THEN z.b END AS predicted_b, depth AS assigned_depth, CASE WHEN coalesce(n, 0) < 1 THEN 'unreadable' WHEN depth < 2 THEN 'below threshold' ELSE '' END AS review_reason, len({TOKENS})::INT AS n_tokens, coalesce(n, 0)::INT AS n_known_tokens
FROM (SELECT *, CASE WHEN pb >= 0.5 THEN 2 WHEN pa >= 0.5 THEN 1 ELSE 0 END AS depth FROM z WHERE place = 1) z JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)""")
def document_classes(spark, sf):
    """Whole text recipe: language, then language and source, by naive Bayes on the 5000 most frequent terms, scored as new rows."""
    from taxolith.operators import sparse
    from taxolith.plans.score import score
    from taxolith.sources.bundle import Bundle

    docs = read(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("a"), F.concat_ws("/", "lang", F.when(F.col("source") < "src2", "low").otherwise("high")).alias("b"))
    own = sparse.fit_table(docs, "doc_id", "text", hierarchy.Tree.fit(docs, ["a", "b"]), features.Features("count", min_df=3, most=5000, binary=True))
    out = score(docs, Bundle(own, thresholds={"level": {1: 0.5, 2: 0.5}}), text_col="text", key="doc_id")
    return out.select("doc_id", "predicted_a", "predicted_b", "assigned_depth", "review_reason", "n_tokens", "n_known_tokens")
