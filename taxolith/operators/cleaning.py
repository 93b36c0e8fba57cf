"""The full cleaning recipe as one value that training and scoring share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolith.functions import text as T
from taxolith.functions import word_lists

ORIGINAL = "text_original"


@dataclass
class Cleaner:
    """Blank nulls, upper case, leading code, spelling, the two pattern passes, abbreviations, known tokens: in this
    order, since spelling needs whole words, abbreviations bare ones, and the filter comes after both. Keeps all rows."""

    lists: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(word_lists.DEFAULT))
    upper: bool = False
    strip_code: bool = True
    spelling: Mapping[str, str] = field(default_factory=dict)
    expansions: Mapping[str, str] = field(default_factory=dict)
    known: Sequence[str] = ()
    least: int = 2

    def column(self, c: Column, first_is_word: Column | None = None) -> Column:
        """first_is_word: 1 if the text's first token is an English word, 0 if it is a code to drop."""
        c = F.coalesce(c, F.lit(""))
        c = F.upper(c) if self.upper else c
        if self.strip_code and first_is_word is not None:
            c = T.drop_first_word(c, first_is_word)
        c = T.expand(c, self.spelling)
        first, then, second, last = word_lists.patterns(self.lists)
        c = T.strip(T.replace(T.delete(T.replace(T.delete(c, first), then), second), last))
        c = T.expand(c, self.expansions)
        return T.strip(T.keep_known(c, self.known, self.least) if self.known else c)

    def record(self) -> dict:
        return {k: dict(v) if isinstance(v, Mapping) else v for k, v in asdict(self).items()}


def with_first_word_flag(df: DataFrame, text_col: str, vocabulary: DataFrame, flag: str = "first_word_real") -> DataFrame:
    """1 where the first word is longer than two characters, has no digit and is in vocabulary(word)."""
    known = vocabulary.select(F.lower(T.strip(F.col("word"))).alias("_word")).distinct().withColumn("_known", F.lit(1))
    out = df.withColumn("_word", T.first_word(F.col(text_col))).join(known, "_word", "left")
    return out.withColumn(flag, F.when(T.may_be_word(F.col("_word")), F.coalesce("_known", F.lit(0))).otherwise(0)).drop("_word", "_known")


def cleaned(df: DataFrame, text_col: str, cleaner: Cleaner, vocabulary: DataFrame | None = None, markers: Mapping[str, Mapping] | None = None, drop_blank: bool = False) -> DataFrame:
    """The text cleaned in place, the given one kept in ORIGINAL; markers {column: {prefix, levels, missing}} in front."""
    out = applied(df.withColumn(ORIGINAL, F.col(text_col)), text_col, cleaner, vocabulary, markers)
    return out.where(T.strip(F.col(text_col)) != "") if drop_blank else out


def applied(df: DataFrame, text_col: str, cleaner: Cleaner, vocabulary: DataFrame | None = None, markers: Mapping[str, Mapping] | None = None) -> DataFrame:
    """The text cleaned in place, for training and for scoring alike; all rows stay."""
    flag = None
    if cleaner.strip_code and vocabulary is not None:
        df, flag = with_first_word_flag(df, text_col, vocabulary, "_flag"), F.col("_flag")
    out = df.withColumn(text_col, cleaner.column(F.col(text_col), flag)).drop("_flag")
    if markers:
        tokens = [T.marker(F.col(c), m.get("prefix", ""), m.get("levels", ()), m.get("missing")) for c, m in markers.items()]
        out = out.withColumn(text_col, T.with_markers(F.col(text_col), tokens))
    return out


def step_counts(df: DataFrame, text_col: str, cleaner: Cleaner, vocabulary: DataFrame | None = None, markers: Mapping[str, Mapping] | None = None, known: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """step, rows, blank, changed of the stand-alone procedure, from one pass: after each step, how many rows there are, how
    many have no text left, and how many the step changed. With known(token) and a key the token filter is a step too."""
    rows = df.withColumn("_0", F.coalesce(F.col(text_col), F.lit("")))
    cleaned_rows = applied(rows.withColumn("_1", F.col("_0")), "_1", cleaner, vocabulary)
    steps = ["given", "cleaned"]
    if known is not None:
        cleaned_rows = keep_known_tokens(cleaned_rows.withColumn(f"_{len(steps)}", F.col(f"_{len(steps) - 1}")), key, f"_{len(steps)}", known, cleaner.least)
        steps.append("known tokens")
    if markers:
        tokens = [T.marker(F.col(c), m.get("prefix", ""), m.get("levels", ()), m.get("missing")) for c, m in markers.items()]
        cleaned_rows = cleaned_rows.withColumn(f"_{len(steps)}", T.with_markers(F.col(f"_{len(steps) - 1}"), tokens))
        steps.append("markers")
    each = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("step"), (T.strip(F.col(f"_{k}")) == "").cast("int").alias("blank"), (F.col(f"_{k}") != F.col(f"_{max(k - 1, 0)}")).cast("int").alias("changed")) for k, name in enumerate(steps)]
    long = cleaned_rows.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return long.groupBy("place", "step").agg(F.count("*").alias("rows"), F.sum("blank").alias("blank"), F.sum("changed").alias("changed")).drop("place")


def keep_known_tokens(df: DataFrame, key: str, text_col: str, known: DataFrame, least: int = 2) -> DataFrame:
    """As T.keep_known for a set of any size: known(token). Every row stays, with its kept tokens in order."""
    have = known.select(F.upper("token").alias("_t")).distinct()
    tokens = df.select(key, F.posexplode(T.words(F.coalesce(F.col(text_col), F.lit("")))).alias("_p", "_w")).where(F.length("_w") >= least).withColumn("_t", F.upper("_w"))
    kept = tokens.join(have, "_t", "left_semi").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_w"))), lambda x: x["_w"]), " ").alias("_kept"))
    return df.join(kept, key, "left").withColumn(text_col, F.coalesce("_kept", F.lit(""))).drop("_kept")


def known_tokens(vocabulary: DataFrame, good: DataFrame, expansions: Mapping[str, str]) -> DataFrame:
    """token: vocabulary(word), good(token), abbreviations and the words of what they stand for, in upper case."""
    spark = vocabulary.sparkSession
    own = sorted({w.upper() for k, v in expansions.items() for w in (k, *v.split())})
    extra = spark.createDataFrame([(w,) for w in own], "token string")
    parts = vocabulary.select(F.upper("word").alias("token")).unionByName(good.select(F.upper("token").alias("token"))).unionByName(extra)
    return parts.where("token is not null and token <> ''").distinct()
