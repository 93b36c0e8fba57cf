"""The catalogue engine: goldens, invariants, readers, bundle, resumable runs and streaming."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from taxolith.functions import arrays as A
from taxolith.functions import text as T
from taxolith.functions import tokens as N
from taxolith.functions import word_lists
from taxolith.operators import calibration, cleaning, evaluation, features, filters, hierarchy, lookup, models, splits, tokens
from taxolith.plans import crossval, fits, queries, recipes, runs
from taxolith.plans.score import readability, score
from taxolith.sources import bundle, io
from taxolith.streaming import score as streaming

DESCRIPTIONS = [
    "X1234 HOSE 1/2X3 RED 10FT", "BOLT HEX 1-1/2 X 3IN ZINC", "GLOVE NITRILE XL/XXL BLUE 100/BX", "RED RED BALL", "6203-2RS BEARING", "CROUSE-HINDS COND BODY LB", "TAPE 3M W/ DISPENSER 12X36", "", "SHIRT SZ XL 4XL 30L",
    "O'RING 1.5 (DV) 12CT", "IN FT XIN -", "PIPE 2 GAL 20GAL", "ÉCROU\tM10  NOIR\n", "VALVE 3/4 BRASS/GREEN X",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate([*DESCRIPTIONS, None])], "id long, text string")


def test_patterns_as_python_reads_them(texts):
    first, then, second, last = word_lists.patterns()
    got = {r.id: r.x for r in texts.select("id", cleaning.Cleaner(strip_code=False).column(F.col("text")).alias("x")).collect()}
    for k, t in enumerate(DESCRIPTIONS):
        for p in first:
            t = re.sub(p, "", t)
        for p, to in then.items():
            t = re.sub(p, to, t)
        for p in second:
            t = re.sub(p, "", t)
        for p, to in last.items():
            t = re.sub(p, to, t)
        assert got[k] == t.strip(), DESCRIPTIONS[k]
    assert got[len(DESCRIPTIONS)] == ""


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "SS ST SSST ss", lambda c: T.expand(c, {"SS": "STAINLESS ST", "ST": "STEEL"})) == "STAINLESS ST STEEL SSST ss"
    assert one(spark, "a.b a", lambda c: T.expand(c, {"a.b": "$1", "a": "z"})) == "$1 z"
    assert one(spark, " \tA  b\n", T.text_key) == "a b"
    assert one(spark, " N/A ", T.blank_nulls) == "" and one(spark, None, T.blank_nulls) == ""
    assert one(spark, "4 X 6 RED 4 IN, x", lambda c: T.light_clean(c, [["Red"]])) == "4X6 4IN X"
    assert one(spark, "a bb ccc", lambda c: T.light_clean(c, least=2)) == "BB CCC"
    assert one(spark, "46 18", lambda c: T.marker(c, "U", (2, 4, 8))) == ["U2_46", "U4_4618"]
    assert one(spark, "", lambda c: T.marker(c, "U")) == [] and one(spark, "", lambda c: T.marker(c, "U", (), "NONE")) == ["UNONE"]
    assert one(spark, "Bolt and ab xy", lambda c: T.keep_known(c, ["BOLT", "XY"])) == "Bolt xy"
    assert one(spark, "\"Hello, world", T.first_word) == "hello"
    assert one(spark, "code12 bolt", lambda c: T.drop_first_word(c, F.lit(0))) == "bolt"


def test_every_query_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents embeddings benchmark labels".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda rows: sorted([tuple(round(float(v), 5) if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert set(queries.ORACLES) > {f.__name__ for f in (fits.svc_on_two, recipes.id_list, runs.refused_run)}  # those modules register theirs
    for name, sql in queries.ORACLES.items():
        df, want = queries.QUERIES[name](spark, sf), con.sql(sql)
        columns = sorted(df.columns)
        assert columns == sorted(want.columns), name
        place = [want.columns.index(c) for c in columns]
        assert plain(df.select(*[f"`{c}`" for c in columns]).collect()) == plain([tuple(r[k] for k in place) for r in want.fetchall()]), name


def test_tokens_and_pruning(spark):
    df = spark.createDataFrame([(1, "Ab ab c dé_1"), (2, None), (3, "ab zz zz")], "id long, text string")
    assert [r.t for r in df.select(N.tokenize(F.col("text")).alias("t")).collect()] == [["ab", "ab", "dé_1"], [], ["ab", "zz", "zz"]]
    assert [r.g for r in df.select(N.folded(N.ngrams(N.tokenize(F.col("text")), 2, 3)).alias("g")).collect()] == [["ab ab", "ab dé_1", "ab ab dé_1"], [], ["ab zz", "zz zz", "ab zz zz"]]
    index = tokens.token_index(df, "text", min_df=2)
    assert {r.id: r.ids for r in tokens.encoded(df, "id", "text", index).collect()} == {1: [2, 2], 2: [1], 3: [2]}
    assert {r.id: r.text for r in tokens.pruned(df, "id", "text", index.select("token")).collect()} == {1: "ab ab", 2: "", 3: "ab"}
    assert tokens.oov_rate(df.where("false"), "text", index).first().oov_rate == 0


def test_filters(spark):
    df = spark.createDataFrame([("01", "x", "a"), (" 2", " ", "a"), ("3", "y", None), ("4", "y", "nan")], "id string, text string, l string")
    assert [r.id for r in filters.drop_null_rows(df, "text", ["l"]).collect()] == ["01"]
    ids = spark.createDataFrame([("2",), ("01",), ("9",), ("2",)], "id string")
    assert sorted(r.id for r in filters.drop_ids(df, ids, "id").collect()) == ["3", "4"]
    assert tuple(filters.drop_report(df, ids, "id").first()) == (2, 2, 1)
    assert filters.drop_rare_classes(df, "l", 2).count() == 2 and filters.drop_rare_classes(df, "l", 1).count() == 4
    assert filters.drop_rare_paths(spark.createDataFrame([(None, "a"), (None, "a"), ("b", "a")], "x string, y string"), ["x", "y"]).count() == 2
    with pytest.raises(ValueError):
        filters.check_columns(df, ["gone"])


def test_folds_do_not_depend_on_other_rows(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    got = {r.k: r.fold for r in splits.id_hash_fold(df, "k").collect()}
    assert got == {k: int(hashlib.sha1(f"0|{k}".encode()).hexdigest()[:16], 16) % 5 for k in range(200)}
    assert got == {r.k: r.fold for r in splits.id_hash_fold(df.repartition(7), "k").collect()}
    assert splits.data_fingerprint(df, ["k"]).first() == splits.data_fingerprint(df.repartition(5), ["k"]).first()
    with pytest.raises(Exception, match="blank"):
        splits.id_hash_fold(spark.createDataFrame([(" ",)], "k string"), "k").collect()
    train, held = splits.split(df.withColumn("l", F.col("k") % 3), "k", "l", 0.2)
    assert train.count() + held.count() == 200 and held.select("l").distinct().count() == 3


@pytest.fixture(scope="module")
def vectors(spark):
    return queries._vectors(spark, "/root/testdata/sf0.001")


def test_tree_scores(spark, vectors):
    tree = hierarchy.Tree.fit(vectors, queries.LEVELS)
    assert hierarchy.Tree.of_record(tree.record()) == tree
    df, probs = models.fit_levels(vectors, tree, "embedding").probabilities(vectors, "embedding")
    own = hierarchy.path_scores(df, tree, probs, "conditional").select(A.total(F.transform("scores", lambda s: F.exp(s))).alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in own)
    out = hierarchy.predictions(tree.encode(df), tree, probs)
    acc = [r.accuracy for r in evaluation.per_prefix(out, queries.LEVELS).orderBy("depth").collect()]
    assert acc[0] >= acc[1]
    for t in (0.5, 3.0):
        same = calibration.with_temperature(df.withColumn("z", F.transform(probs[1], lambda x: F.log(x))), "z", t, "q")
        assert same.where(A.arg_max(F.col("q")) != A.arg_max(F.col(probs[1]))).count() == 0
    code = tree.encode(spark.createDataFrame([("9", None), ("0", "0")], "l1 string, l2 string")).orderBy("l2").collect()
    assert [(r.code_l1, r.code_l2) for r in code] == [(-1, -1), (0, 0)]


def test_bands_and_thresholds(spark):
    df = spark.createDataFrame([(0.3, True), (1.0, True), (0.0, False), (0.65, False)], "c double, ok boolean")
    bands = {r.band: r.rows for r in evaluation.by_band(df, "c", F.col("ok")).collect()}
    assert bands[9] == 1 and bands[0] == 1 and sum(bands.values()) == 4 and len(bands) == 10
    assert calibration.thresholds(df, "c", "ok").first().threshold == 0.66
    assert calibration.thresholds(df.withColumn("ok", F.lit(False)), "c", "ok").first().threshold is None


@pytest.mark.parametrize("name", ["lda", "ridge", "gaussian_nb"])
def test_models_give_probabilities(vectors, name):
    levels = queries.LEVELS
    tree = hierarchy.Tree.fit(vectors, levels)
    df, probs = models.fit_levels(vectors, tree, "embedding", name).probabilities(vectors, "embedding")
    for p, n in zip(probs, tree.sizes):
        assert all(len(r.p) == n and abs(sum(r.p) - 1) < 1e-6 for r in df.select(F.col(p).alias("p")).limit(20).collect())
    right = tree.encode(df).where(F.col(f"code_{levels[-1]}") == A.arg_max(F.col(probs[-1])))
    assert right.count() > 1.5 / tree.sizes[-1] * df.count()
    with pytest.raises(KeyError):
        models.fitter("no such model")


def test_lookup_and_pooling(spark):
    df = spark.createDataFrame([("A b", "x", "y"), ("a  B", "x", "y"), ("a b", "x", "z"), ("c", "q", "r")], "t string, l1 string, l2 string")
    table = lookup.fit(df, "t", ["l1", "l2"])
    assert {r.text_key: (r.l1, r.l2, r.support, round(r.purity, 3)) for r in table.collect()} == {"a b": ("x", "y", 3, 0.667), "c": ("q", "r", 1, 1.0)}
    assert sorted(r.hit for r in lookup.predict(df, "t", table, ["l1", "l2"]).collect()) == [False, True, True, True]
    docs = spark.createDataFrame([(1, "aa bb zz"), (2, "zz")], "id long, text string")
    words = spark.createDataFrame([("aa", [1.0, 0.0]), ("bb", [3.0, 2.0])], "token string, vector array<double>")
    assert {r.id: r.vector for r in features.document_vectors(docs, "id", "text", words, 2).collect()} == {1: [2.0, 1.0], 2: [0.0, 0.0]}


def test_readers(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "colors.txt").write_text("Color\nRed\n\n Blue \n")
    (tmp_path / "lists" / "good_tokens.csv").write_text("t\nx\n")
    assert {k: sorted(v) for k, v in io.word_lists(spark, str(tmp_path / "lists")).items()} == {"colors": ["Blue", "Red"]}
    for sep, name in ((",", "a"), ("\t", "b"), ("|", "c")):
        (tmp_path / f"{name}.csv").write_text(f"﻿name{sep}Item ID\nx{sep}\"007\"\ny{sep}8\nz{sep}\nw{sep}8\n")
        assert sorted(r.id for r in io.read_ids(spark, str(tmp_path / f"{name}.csv")).collect()) == ["007", "8"]
    (tmp_path / "plain.txt").write_text("17\n18\n17\n")
    assert sorted(r.id for r in io.read_ids(spark, str(tmp_path / "plain.txt")).collect()) == ["17", "18"]
    (tmp_path / "pairs.csv").write_text("a,b\nss,stainless\nst,\n")
    assert io.read_pairs(spark, str(tmp_path / "pairs.csv"), blank_to=True) == {"SS": "STAINLESS", "ST": ""}
    assert io.read_pairs(spark, str(tmp_path / "gone.csv"), required=False) == {}
    with pytest.raises(ValueError):
        io.read_pairs(spark, str(tmp_path / "pairs.csv"))
    df = spark.createDataFrame([("007", "a")], "id string, t string")
    io.write_delimited(df, str(tmp_path / "out"))
    assert io.read_delimited(spark, str(tmp_path / "out")).collect() == df.collect()


def test_bundle_score_and_stream(spark, vectors, tmp_path):
    tree = hierarchy.Tree.fit(vectors, queries.LEVELS)
    own = models.fit_levels(vectors, tree, "embedding")
    path = str(tmp_path / "bundle")
    bundle.save(spark, path, bundle.Bundle(own, thresholds={"level": {1: 0.5, 2: None}}, stamp={"arm": "a"}))
    loaded = bundle.load(spark, path, {"arm": "a"})
    assert loaded.models.models == own.models and loaded.thresholds["level"] == {1: 0.5, 2: None}
    with pytest.raises(ValueError):
        bundle.load(spark, path, {"arm": "b"})
    whole = score(vectors, loaded, "embedding").select("vec_id", "predicted_l1", "assigned_depth", "needs_review")
    assert whole.count() == vectors.count() and whole.where("assigned_depth = 2").count() == 0
    vectors.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.arriving(spark, str(tmp_path / "in"), vectors.schema)
    run = streaming.start(stream, loaded, str(tmp_path / "scored"), str(tmp_path / "state"), once=True, features="embedding")
    run.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "scored")).select(*whole.columns)
    assert sorted(got.collect()) == sorted(whole.collect())
    known = readability(spark.createDataFrame([("ab zz",), (None,)], "t string"), "t", F.array(F.lit("ab"))).collect()
    assert [(r.n_tokens, r.n_known_tokens, r.known_share) for r in known] == [(2, 1, 0.5), (0, 0, 0.0)]


def test_resumable_run(spark, vectors, tmp_path):
    path = str(tmp_path / "run")
    crossval.run(spark, vectors, path, "vec_id", "embedding", queries.LEVELS, k=3, only=[0])
    with pytest.raises(ValueError, match="not finished"):
        crossval.collect_folds(spark, path, 3)
    with pytest.raises(ValueError, match="another run"):
        crossval.run(spark, vectors, path, "vec_id", "embedding", queries.LEVELS, k=3, config={"x": 1})
    crossval.run(spark, vectors, path, "vec_id", "embedding", queries.LEVELS, k=3)
    assert [r.done for r in crossval.status(spark, path, 3).collect()] == [True] * 3
    assert crossval.collect_folds(spark, path, 3).count() == vectors.count()


def test_word_lists_are_read_whole(spark, tmp_path):
    from taxolith.sources import io

    (tmp_path / "long.csv").write_text("term\n" + "\n".join(f"w{k}" for k in range(1_000_005)))
    (tmp_path / "bare.csv").write_text("term")
    assert [(r["list"], r["count"]) for r in io.read_words(spark, str(tmp_path)).groupBy("list").count().collect()] == [("long", 1_000_005)]


def test_training_and_scoring_clean_alike(spark):
    words = spark.createDataFrame([("hose",), ("bolt",), ("glove",)], "word string")
    rows = spark.createDataFrame([(1, "X1234 HOSE 10FT", "v1", "a"), (2, "BOLT HEX 3IN", "v2", "b"), (3, "GLOVE", None, "a"), (4, None, "v1", "b"), (5, "Z9", "v1", "a")], "id long, text string, vendor string, l string")
    cleaner, markers = cleaning.Cleaner(expansions={"HEX": "HEXAGON"}), {"vendor": {"prefix": "VND_"}}
    trained = cleaning.cleaned(rows, "text", cleaner, words, markers)
    vectorizer = features.fitted(features.Features("count", min_df=1, max_df=1.0), trained.withColumn("_clean", F.col("text")), "_clean")
    own = models.fit_levels(vectorizer.transform(trained.withColumn("_clean", F.col("text"))), hierarchy.Tree.fit(rows, ["l"]), "features", "multinomial_nb")
    b = bundle.Bundle(own, vectorizer, cleaner.record(), tables={"vocabulary": words})
    scored = score(rows, b, text_col="text", markers=markers)
    want = {r.id: len(N_TOKEN(r.text)) for r in trained.collect()}
    assert {r.id: r.n_tokens for r in scored.collect()} == want and want[1] == 2  # HOSE and the marker: the leading code and the size are gone
    assert all(r.n_tokens == r.n_known_tokens for r in scored.collect())
    assert {r.id: r.text for r in trained.collect()}[5] == "VND_v1"  # a code alone leaves nothing but the marker


def N_TOKEN(text):
    return [w for w in re.findall(r"\w{2,}", text.lower())]


def test_known_tokens_count_each_time(spark):
    df = spark.createDataFrame([(1, "ab ab cd zz"), (2, "zz"), (3, None), (4, "ab cd")], "id long, t string")
    for how in (features.Features("count", 1, 2, min_df=2, max_df=1.0, most=None, binary=True), features.Features("count", 1, 1, min_df=2, max_df=1.0, most=None)):
        words = features.fitted(how, df, "t").stages[-1].vocabulary
        got = {r.id: (r.n_tokens, r.n_known_tokens, r.known_share) for r in readability(df, "t", words).collect()}
        assert got == {1: (4, 4, 1.0), 2: (1, 1, 1.0), 3: (0, 0, 0.0), 4: (2, 2, 1.0)}
    assert readability(df, "t", []).agg({"n_known_tokens": "sum"}).first()[0] == 0


def test_vectors_have_the_features_that_are_counted(spark):
    df = spark.createDataFrame([(1, "b a c the"), (2, "aa bb the aa bb"), (3, "bb aa dd")], "id long, t string")
    for how in (features.Features("count", 1, 2, min_df=1, max_df=1.0, most=None, fold=True, stop_words=("the",)), features.Features("count", 2, 3, min_df=1, max_df=1.0, most=None)):
        chosen = {r.feature for r in features.fit_transform(df, [], "id", "t", how)[2].collect()}
        assert set(features.fitted(how, df, "t").stages[-1].vocabulary) == chosen


def test_own_models_logits_and_history(spark, vectors):
    tree = hierarchy.Tree.fit(vectors, queries.LEVELS)
    models.register("halved", lambda df, f, c, n: models.fit_centroids(df, f, c, n, temperature=0.2), "one aggregation")
    for name in ("halved", "logistic"):
        own = models.fit_levels(vectors, tree, "embedding", name)
        df, probs = own.probabilities(vectors, "embedding", logits=True)
        gap = df.select(F.array_max(F.zip_with(A.softmax(F.col("logits_l2")), probs[1], lambda a, b: F.abs(a - b))).alias("g")).agg(F.max("g")).first()[0]
        assert gap < 1e-9
    steps = models.history(own, spark).collect()
    for level in ("l1", "l2"):
        own = [r.objective for r in sorted(steps, key=lambda r: r.step) if r.level == level]
        assert len(own) > 1 and own[0] > own[-1]


def test_ranks_within_classes(spark):
    df = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, None).otherwise("b").alias("l"))
    got = splits.ranked(df, "l", "k", 0).collect()
    for label in ("a", "b", None):
        own = [r for r in got if r.l == label]
        assert sorted(r._rank for r in own) == list(range(1, len(own) + 1)) and {r._size for r in own} == {len(own)}
    assert [r.k for r in splits.ranked(df, "l", "k", 0, bits=2).orderBy("l", "_rank").collect()] == [r.k for r in splits.ranked(df, "l", "k", 0).orderBy("l", "_rank").collect()]


def test_recipe_refuses_another_run_and_goes_on(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    path, how = str(tmp_path / "run"), features.Features("count", min_df=2, max_df=1.0, most=None)
    bad = docs.where("doc_id < 10").selectExpr("doc_id AS id")
    crossval.run_recipe(spark, docs, path, "doc_id", "text", ["lang"], how, k=2, only=[1], blacklist=bad, min_count=2)
    with pytest.raises(ValueError, match="another run"):
        crossval.run_recipe(spark, docs, path, "doc_id", "text", ["lang"], how, k=2, blacklist=bad, min_count=3)
    crossval.run_recipe(spark, docs, path, "doc_id", "text", ["lang"], how, k=2, blacklist=bad, min_count=2)
    done = crossval.collect_folds(spark, path, 2)
    assert done.count() == docs.count() and evaluation.path_accuracy(done, ["lang"]).first().accuracy > 0.9
    train_all, _, _ = crossval.recipe_fold(splits.id_hash_fold(docs, "doc_id", 2), 0, "doc_id", "text", ["lang"], how, blacklist=bad, scope="all")
    assert train_all.join(bad, train_all.doc_id == bad.id).count() == 0
    lone = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "xx").otherwise(F.col("lang")))
    fold = splits.id_hash_fold(lone, "doc_id", 2)
    held = fold.where("doc_id = 3").first().fold
    kept, _, _ = crossval.recipe_fold(fold, held, "doc_id", "text", ["lang"], how)
    gone, _, _ = crossval.recipe_fold(fold, held, "doc_id", "text", ["lang"], how, keep_unwinnable=False)
    assert kept.where("not winnable").count() == 1 and kept.count() == gone.count() + 1
