"""Count and TF-IDF features in long form and as vectors, word vectors and pooled documents."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, SQLTransformer, StandardScaler, Word2Vec
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import tokens as N

#: Bytes of text that are met with a table at a time.
BUCKET = 8 << 20
#: Buckets for whose terms there is a task that looks them up.
ASKED = 4
#: Pairs of a text and a term whose numbers are multiplied at a time.
PAIRS = 1 << 15
#: Terms of texts that are met with a small table at a time, and rows that are given back at a time.
SLICE, ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Features:
    """min_df and max_df are counts if they are whole numbers and shares of rows if they are fractions."""

    kind: str = "tfidf"
    low: int = 1
    high: int = 1
    min_df: float = 2
    max_df: float = 0.95
    most: int | None = 16000
    binary: bool = False
    sublinear: bool = True
    use_idf: bool = True
    norm: str | None = "l2"
    fold: bool = False
    stop_words: tuple[str, ...] = ()

    def grams(self, c: Column) -> Column:
        tokens = N.tokenize(c)
        if self.stop_words:
            tokens = F.filter(tokens, lambda t: ~t.isin(*self.stop_words))
        return N.ngrams(tokens, self.low, self.high, self.fold)


def term_counts(df: DataFrame, key: str, text_col: str, how: Features, labels: Sequence[str] = ()) -> DataFrame:
    """key, labels, feature, tf, counted within a text: no table of all texts' terms is held or moved. Only where keys
    repeat are the texts of a key (and labels) brought together first."""
    own = [key, *labels]
    if unique(df, *own):
        grams = how.grams(F.col(text_col))
        return df.select(*own, F.inline(N.counted(grams, how.binary)))
    texts = df.groupBy(*own).agg(F.collect_list(text_col).alias("_texts"))
    return texts.select(*own, F.inline(N.counted(F.flatten(F.transform("_texts", how.grams)), how.binary)))


def unique(df: DataFrame, *keys: str) -> bool:
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def selected(counts: DataFrame, n_rows: int, how: Features) -> DataFrame:
    """feature, df, total: those within the document frequency limits, the most frequent terms if there is a cap."""
    return within(counts.groupBy("feature").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), n_rows, how)


def within(found: DataFrame, n_rows: int, how: Features) -> DataFrame:
    """The same of rows feature, df, total."""
    least = how.min_df if float(how.min_df).is_integer() and how.min_df >= 1 else how.min_df * n_rows
    most = how.max_df if float(how.max_df).is_integer() and how.max_df > 1 else how.max_df * n_rows
    found = found.where((F.col("df") >= least) & (F.col("df") <= most))
    return found.orderBy(F.desc("total"), "feature").limit(how.most) if how.most else found


@dataclass
class Met:
    """A bucket's texts beside the rows of a table that have one of their terms.

    keys: the distinct ones; row, term, tf: a place in keys, a place in names and how often they meet, by row and term; at: the
    places in names of the table's rows; order: row and term of every occurrence of a known term, as in the texts."""

    keys: pa.Array
    names: pa.Array
    row: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    table: pa.Table
    at: np.ndarray
    order: tuple[np.ndarray, np.ndarray]

    def column(self, name: str) -> np.ndarray:
        """The table's column by names, for tables of one row a term."""
        out = np.zeros(len(self.names))
        out[self.at] = self.table.column(name).to_numpy()
        return out


def buckets(df: DataFrame, text_col: str) -> int:
    """How many buckets of `BUCKET` bytes the texts fill."""
    size = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    return max(1, -(-size // BUCKET))


def met(df: DataFrame, key: str, text_col: str, how: Features, table: DataFrame, run: Callable[[Met], Mapping[str, pa.Array]], schema: str, small: bool = False) -> DataFrame:
    """What `run` gives for the texts of each bucket beside the rows of `table` (feature, ...) that have one of their terms.

    Texts are dealt by key to buckets of about `BUCKET` bytes, and each bucket asks for each of its terms once: the texts
    move, and a bucket's distinct terms, but no single occurrence. The texts of a key are one. The table is dealt by term to at
    least a task for every `ASKED` buckets, so that what a task looks up does not grow. A small table goes to every task, where
    texts whose keys are unique meet it as they are read, some at a time: then no text moves, and none asks for its terms."""
    texts = df.select(key, F.col(text_col).alias("_text"))
    if small and unique(texts, key):
        return _met_as_read(texts.select(key, how.grams(F.col("_text")).alias("_grams")), table, run, schema, how.binary)
    n = buckets(texts, "_text")
    bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    dealt = texts.repartition(n, bucket).withColumn("_bucket", bucket)  # worked out behind the exchange: both readers then need the same columns, and share it
    asked = dealt.select(F.col("_bucket").alias("_for"), F.explode(F.array_distinct(how.grams(F.col("_text")))).alias("feature")).distinct()
    asked = asked if small else asked.repartition(-(-n // ASKED), "feature")
    found = asked.join(F.broadcast(table) if small else table.hint("shuffle_hash"), "feature").repartition(n, "_for")

    def task(texts: pa.Table, table: pa.Table) -> pa.Table:
        return pa.table(run(_met(texts.column(key), texts.column("_grams"), table, _coded(table), how.binary)))

    rows = dealt.select("_bucket", key, how.grams(F.col("_text")).alias("_grams"))
    return rows.groupBy("_bucket").cogroup(found.groupBy("_for")).applyInArrow(task, schema)


def _met_as_read(rows: DataFrame, table: DataFrame, run: Callable[[Met], Mapping[str, pa.Array]], schema: str, binary: bool) -> DataFrame:
    """The same for rows of unique keys and their terms, and a table that the driver sends to every task."""
    sent = rows.sparkSession.sparkContext.broadcast(table.toArrow())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        feature = _coded(own)
        for batch in batches:
            for part in _slices(batch):
                keys, grams = (pa.chunked_array([part.column(k)]) for k in (0, 1))
                yield from pa.table(run(_met(keys, grams, own, feature, binary))).to_batches(max_chunksize=ROWS)

    return rows.mapInArrow(task, schema)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose terms are about `SLICE`; a longer text is a slice of its own."""
    ends = np.cumsum(pc.list_value_length(batch.column("_grams")).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        end = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _coded(table: pa.Table) -> pa.DictionaryArray:
    return whole(table.column("feature")).dictionary_encode() if table.num_rows else pa.array([], pa.string()).dictionary_encode()


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _met(keys: pa.ChunkedArray, grams: pa.ChunkedArray, table: pa.Table, feature: pa.DictionaryArray, binary: bool) -> Met:
    coded = whole(keys).dictionary_encode("encode")
    rows, terms, start = [], [], 0
    for part in grams.chunks:
        count = part.value_lengths().to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(part.flatten(), value_set=feature.dictionary), -1).to_numpy(zero_copy_only=False)
        known = term >= 0
        rows.append(np.repeat(coded.indices.to_numpy()[start : start + len(part)].astype(np.int64), count)[known])
        terms.append(term[known].astype(np.int64))
        start += len(part)
    row, term = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, terms))
    many = max(len(feature.dictionary), 1)
    pairs, tf = np.unique(row * many + term, return_counts=True)
    return Met(coded.dictionary, feature.dictionary, pairs // many, pairs % many, np.ones(len(pairs)) if binary else tf.astype(float), table, feature.indices.to_numpy(), (row, term))


def weighted(df: DataFrame, chosen: DataFrame, n_rows: int, key: str, text_col: str, how: Features) -> DataFrame:
    """key, feature, weight: counts or TF-IDF over the chosen features, rows normalised."""

    def run(own: Met) -> Mapping[str, pa.Array]:
        weight = own.tf
        if how.kind != "count":
            weight = 1 + np.log(own.tf) if how.sublinear else own.tf
            if how.use_idf:
                weight = weight * (np.log((1 + n_rows) / (1 + own.column("df"))) + 1)[own.term]
            if how.norm:
                size = np.bincount(own.row, weight**2 if how.norm == "l2" else np.abs(weight), len(own.keys))
                weight = weight / (np.sqrt(size) if how.norm == "l2" else size)[own.row]
        return {key: own.keys.take(pa.array(own.row)), "feature": own.names.take(pa.array(own.term)), "weight": pa.array(weight, pa.float64())}

    return met(df, key, text_col, how, chosen.select("feature", "df"), run, f"`{key}` {dict(df.dtypes)[key]}, feature string, weight double", small=bool(how.most))


def fit_transform(train: DataFrame, others: Sequence[DataFrame], key: str, text_col: str, how: Features) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Weights of all splits by the training rows' features: nothing of the others is learned."""
    n = train.count()
    chosen = selected(term_counts(train, key, text_col, how), n, how)
    return weighted(train, chosen, n, key, text_col, how), [weighted(o, chosen, n, key, text_col, how) for o in others], chosen


def density(weights: DataFrame, n_rows: int, key: str) -> DataFrame:
    """One row: features, density, mean non-zeros a row."""
    per = weights.groupBy("feature").agg(F.count("*").alias("n")).agg(F.count("*").alias("features"), F.coalesce(F.sum("n"), F.lit(0)).alias("nnz"))
    return per.select("features", (F.col("nnz") / F.greatest(F.col("features") * n_rows, F.lit(1))).alias("density"), (F.col("nnz") / max(n_rows, 1)).alias("mean_nnz"))


def feature_weights(weights: DataFrame, by: str = "df") -> DataFrame:
    """feature, value: document frequency ("df"), total weight ("weight"), or rarity ("idf": fewest rows last)."""
    value = {"df": F.count("*").cast("double"), "weight": F.sum("weight"), "idf": -F.log(1 / F.count("*"))}[by]
    return weights.groupBy("feature").agg(value.alias("value"))


def chosen_density(chosen: DataFrame, n_rows: int) -> DataFrame:
    """The same of the chosen features: every row that has one has a weight for it."""
    per = chosen.agg(F.count("*").alias("features"), F.coalesce(F.sum("df"), F.lit(0)).alias("nnz"))
    return per.select("features", (F.col("nnz") / F.greatest(F.col("features") * n_rows, F.lit(1))).alias("density"), (F.col("nnz") / max(n_rows, 1)).alias("mean_nnz"))


def top_chosen(chosen: DataFrame, n: int, n_rows: int, by: str = "df") -> DataFrame:
    """feature, value, share of rows for the n first of the chosen features by their rows ("df") or occurrences ("total"); ties by name."""
    return chosen.select("feature", F.col(by).cast("double").alias("value"), (F.col("df") / max(n_rows, 1)).alias("share")).orderBy(F.desc("value"), "feature").limit(n)


def top_features(weights: DataFrame, n: int, n_rows: int, by: str = "df") -> DataFrame:
    """feature, value, share of rows for the n first ones; ties by name."""
    per = weights.groupBy("feature").agg(F.count("*").alias("_df"), F.sum("weight").alias("_w"))
    value = F.col("_w") if by == "weight" else F.col("_df").cast("double")
    return per.select("feature", value.alias("value"), (F.col("_df") / max(n_rows, 1)).alias("share")).orderBy(F.desc("value"), "feature").limit(n)


def sweep(df: DataFrame, key: str, text_col: str, spaces: Mapping[str, Features]) -> DataFrame:
    """name, features, density, mean_nnz of each feature space."""
    n, out = df.count(), None
    for name, how in spaces.items():
        row = chosen_density(selected(term_counts(df, key, text_col, how), n, how), n).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def marker_survival(chosen: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """prefix, features, bigrams that use it: how many of the chosen features come from each marker (lower case)."""
    hits = [F.struct(F.lit(p).alias("prefix"), F.count_if(F.col("feature").startswith(p.lower())).alias("features"), F.count_if(F.col("feature").contains(" ") & F.col("feature").rlike(rf"(?:^| ){p.lower()}")).alias("bigrams")) for p in prefixes]
    return chosen.agg(F.array(*hits).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def marker_share(weights: DataFrame, n_rows: int, key: str, prefixes: Sequence[str]) -> DataFrame:
    """prefix, rows, share: how many rows carry a feature of each marker."""
    words = F.split("feature", " ")
    hits = weights.select(key, F.explode(F.array(*[F.when(F.exists(words, _begins(p.lower())), p) for p in prefixes])).alias("prefix")).where("prefix is not null").distinct()
    found = hits.groupBy("prefix").agg(F.count("*").alias("rows"))
    every = weights.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")
    return every.join(found, "prefix", "left").select("prefix", F.coalesce("rows", F.lit(0)).alias("rows"), (F.coalesce("rows", F.lit(0)) / max(n_rows, 1)).alias("share"))


def _begins(prefix: str) -> Callable[[Column], Column]:
    return lambda w: w.startswith(prefix)


def _grams_sql(how: Features, text_col: str) -> str:
    """Features.grams as SQL text, which a saved pipeline can hold."""
    tokens = f"regexp_extract_all(lower(coalesce(`{text_col}`, '')), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0)"
    if how.stop_words:
        listed = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in how.stop_words)
        tokens = f"filter({tokens}, w -> w NOT IN ({listed}))"
    each = ["t" if n == 1 else f"if(size(t) >= {n}, transform(sequence(1, size(t) - {n - 1}), i -> array_join(slice(t, i, {n}), ' ')), cast(array() AS array<string>))" for n in range(how.low, how.high + 1)]
    grams = f"transform(array({tokens}), t -> concat({', '.join(each)}))[0]"
    return f"transform({grams}, g -> if(size(split(g, ' ')) = 2, array_join(array_sort(split(g, ' ')), ' '), g))" if how.fold else grams


def vectorizer(how: Features, text_col: str, n_rows: int, out: str = "features") -> Pipeline:
    """The same counts as sparse vectors, for models and for scoring row by row. Without `most` all features stay."""
    step = CountVectorizer(inputCol="_grams", outputCol=out, minDF=float(how.min_df), maxDF=float(how.max_df if how.max_df > 1 else max(1.0, how.max_df * n_rows)), vocabSize=how.most or (1 << 31) - 1, binary=how.binary)
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {_grams_sql(how, text_col)} AS _grams FROM __THIS__"), step])


def standardised(train: DataFrame, others: Sequence[DataFrame], column: str, out: str) -> list[DataFrame]:
    """Features with the training rows' means and population deviations taken out; constant ones become 0."""
    model = StandardScaler(inputCol=column, outputCol="_sample", withMean=True, withStd=True).fit(train)
    n = train.count()
    width = model.mean.size
    step = ElementwiseProduct(inputCol="_sample", outputCol=out, scalingVec=Vectors.dense([(n / (n - 1)) ** 0.5 if n > 1 else 1.0] * width))
    return [step.transform(model.transform(d)).drop("_sample") for d in (train, *others)]


def word2vec(df: DataFrame, tokens_col: str, size: int = 150, window: int = 5, min_count: int = 2, epochs: int = 5, partitions: int = 4, step: float = 0.025, seed: int = 42) -> DataFrame:
    """token, vector: trained on the tokens (skip-gram)."""
    model = Word2Vec(inputCol=tokens_col, outputCol="_v", vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, numPartitions=partitions, stepSize=step, seed=seed).fit(df)
    from pyspark.ml.functions import vector_to_array

    return model.getVectors().select(F.col("word").alias("token"), vector_to_array("vector").alias("vector"))


def saved_or_trained(df: DataFrame, tokens_col: str, path: str, size: int, **how) -> DataFrame:
    """Word vectors read at path if they are there and as wide as asked for, else trained and written; vectors of another
    width are told of before they are replaced."""
    spark = df.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        found = spark.read.parquet(path)
        first = found.select(F.size("vector").alias("n")).first()
        if first and first.n == size:
            return found
        warnings.warn(f"{path} holds vectors of width {first.n if first else None}, not {size}: they are trained anew", stacklevel=2)
    word2vec(df, tokens_col, size, **how).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def document_vectors(df: DataFrame, key: str, text_col: str, vectors: DataFrame, width: int, pool: str = "mean", normalise: bool = False) -> DataFrame:
    """key, vector: known tokens' vectors pooled; unknown tokens don't count, and without known ones it is zero."""
    zero = F.array_repeat(F.lit(0.0), width)
    table = vectors.select(F.col("token").alias("feature"), F.transform(F.slice("vector", 1, width), lambda x: x.cast("double")).alias("vector"))

    def run(own: Met) -> Mapping[str, pa.Array]:
        none = -np.inf if pool == "max" else 0.0
        each = pc.fill_null(whole(own.table.column("vector")).flatten(), none).to_numpy(zero_copy_only=False).reshape(-1, width)
        by_term, times = np.full((len(own.names), width), none), np.bincount(own.at, minlength=len(own.names))
        (np.maximum if pool == "max" else np.add).at(by_term, own.at, each)
        out, size = np.full((len(own.keys), width), none), np.bincount(own.row, own.tf * times[own.term], len(own.keys))
        for a in range(0, len(own.row), PAIRS):
            row, term, tf = (x[a : a + PAIRS] for x in (own.row, own.term, own.tf))
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            if pool == "max":
                out[row[first]] = np.maximum(out[row[first]], np.maximum.reduceat(by_term[term], first))
            else:
                out[row[first]] += np.add.reduceat(by_term[term] * tf[:, None], first)
        there = np.flatnonzero(size)
        out = out[there] / size[there][:, None] if pool == "mean" else out[there]
        return {key: own.keys.take(pa.array(there)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * width, pa.int32()), pa.array(out.ravel(), pa.float64()))}

    pooled = met(df.where(F.col(key).isNotNull()), key, text_col, Features("count"), table, run, f"`{key}` {dict(df.dtypes)[key]}, vector array<double>")
    out = df.select(key).join(pooled, key, "left").select(key, F.coalesce("vector", zero).alias("vector"))
    if normalise:
        size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        out = out.withColumn("_s", size).withColumn("vector", F.when(F.col("_s") > 0, F.transform("vector", lambda x: x / F.col("_s"))).otherwise(F.col("vector"))).drop("_s")
    return out


def embedding_matrix(index: DataFrame, vectors: DataFrame, width: int, seed: int = 0, padding: int | None = 0) -> DataFrame:
    """index, token, vector, hit: known tokens have theirs, others normal noise of deviation 1 / sqrt(width) by hash. The
    row of the padding index, which stands for no token, is zero."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: (F.pmod(F.xxhash64("token", k, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30))
    again = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: (F.pmod(F.xxhash64("token", k, F.lit(seed + 1)), F.lit(1 << 30)) + 0.5) / (1 << 30))
    noise = F.zip_with(draws, again, lambda u, v: F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v) / width**0.5)
    out = index.select("index", "token").join(vectors.select("token", F.col("vector").cast("array<double>").alias("vector")), "token", "left")
    out = out.select("index", "token", F.coalesce("vector", noise).alias("vector"), F.col("vector").isNotNull().alias("hit"))
    if padding is None:
        return out
    pad = index.sparkSession.createDataFrame([(padding,)], "index int").select("index", F.lit(None).cast("string").alias("token"), F.array_repeat(F.lit(0.0), width).alias("vector"), F.lit(False).alias("hit"))
    return pad.unionByName(out)


def hit_rate(matrix: DataFrame) -> DataFrame:
    """One row: the share of tokens that have a vector of their own; the padding row does not count."""
    return matrix.where("token is not null").agg(F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.count("*").alias("tokens"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def neighbours(vectors: DataFrame, token: str, k: int = 10) -> DataFrame:
    """token, similarity: the k nearest to one token, whose vector is one small row."""
    one = vectors.where(F.col("token") == token).select("vector").first()
    if one is None:
        return vectors.select("token", F.lit(0.0).alias("similarity")).limit(0)
    target = F.array(*[F.lit(float(x)) for x in one.vector])
    return vectors.where(F.col("token") != token).select("token", cosine(F.col("vector"), target).alias("similarity")).orderBy(F.desc("similarity"), "token").limit(k)


def fitted(how: Features, df: DataFrame, text_col: str) -> PipelineModel:
    return vectorizer(how, text_col, df.count()).fit(df)
