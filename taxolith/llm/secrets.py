"""Secret scans: known forms by pattern, and other random strings by a battery of randomness tests.

Only DataFrame functions run here. Base spans come from three fixed patterns. Then every run of 20 or more characters
of an encoding alphabet that no base span touches and that mixes character classes is tried: its encoding is inferred
(hex, base32, base64), and three statistics are taken of it: chi-squared over a uniform alphabet of 16, 32 or 64 cells (hex
without case), the number of runs of character classes, and the lag-one serial correlation of the classes. They are held
against both ends. Against a uniform string of that alphabet: the chances of a chi-squared as large, and of runs and a
correlation as far off, combined by Fisher's method, must not be below `UNLIKE`. Against a name, which is what a secret must
be told from: each statistic is held against the mean and spread that names of the same encoding and length have, and
Fisher's method combines the chances of a name so near to uniform into the p-value.
Within each encoding and length class (powers of two), a Benjamini-Hochberg step over all candidates of the corpus sets
the largest accepted p-value, so short strings, which the tests can't tell apart, need a stronger result where many of
them are tried. The corpus counts are one small table (p-values in bins), summed in the tasks first; the candidates are
written once for both passes.

Defined cases: null and empty texts have no spans; spans are in code points, end exclusive; repeated rows are scanned
one by one; an empty table gives no rows; other columns are ignored, or kept by `redacted`.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.functions.arrays import bind
from taxolith.llm import common

# The base patterns, by kind, with the group that must have so many characters.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 1, 20), ("hex", HEX, 1, 24))
CANDIDATE = r"([A-Za-z0-9+/_-]{20,}={0,2})"
#: Share of false findings that is accepted among those made.
RATE = 0.05
#: A string that uniform ones of its alphabet are as unlike as this with a smaller chance is no random string.
UNLIKE = 0.001
PAGE = 4096
BIN = 4.0  # bins of the p-value's negative logarithm, by unit
# What ordinary names of an encoding look like, as measured on 6000 made of words, dates and numbers: index of coincidence,
# share of class changes and serial correlation, each with its spread times the root of the length. Hex names repeat
# digits and letters in turn more often than a normal tail allows, so the spreads of their classes are wider than measured.
NAMES = {16: (0.128, 0.282, 0.104, 0.36, 0.685, 0.82), 32: (0.067, 0.1, 0.086, 0.249, 0.56, 1.377), 64: (0.06, 0.098, 0.317, 0.341, 0.279, 1.761)}
#: How often a character of a uniform string is of another class than the one before it (by the sizes of the classes).
CHANGES = {16: 2 * 10 * 6 / 16**2, 32: 2 * 26 * 6 / 32**2, 64: 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2}
UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
SPAN = "array<struct<start:int,kind:int,end:int,name:string>>"


def running(items: Column, after: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) for every item, as an array of the SQL type `kind`; the state is a whole number that begins at 0,
    and after(state, x) follows it.

    Appending to an array copies it, so this goes by cells of about the root of the number of items: a text with very
    many matches costs that number to the power of 1.5 in copied references, not its square."""
    none = F.array().cast(f"array<{kind}>")

    def cells(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        last = F.greatest(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * width + 1, width))

    def whole(c: Column) -> Column:
        states = F.aggregate(c, F.array(F.lit(0)), lambda a, cell: F.concat(a, F.array(F.aggregate(cell, F.element_at(a, -1), after))))
        return F.flatten(F.zip_with(c, F.slice(states, F.lit(1), F.size(c)), one))

    def one(cell: Column, state: Column) -> Column:
        start = F.struct(state.alias("at"), none.alias("out"))
        return F.aggregate(cell, start, lambda a, x: F.struct(after(a["at"], x).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x).cast(kind))).alias("out")), lambda a: a["out"])

    return bind(bind(items, cells), whole)


def matches(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, body>> of the pattern's matches: what lies between them gives their places."""
    kind = "struct<start:int,end:int,body:string>"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"))

    def emit(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        body = x["all"] if group == 1 else F.regexp_extract(x["all"], pattern, group)  # group 1 is the whole match
        return F.struct(start.alias("start"), (start + F.length(x["all"])).alias("end"), body.alias("body"))

    found = running(parts, lambda at, x: at + F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0)), emit, kind)
    return F.when(text.rlike(pattern), F.filter(found, lambda x: x["end"].isNotNull())).otherwise(F.array().cast(f"array<{kind}>"))


def _normal(z: Column) -> Column:
    """The normal distribution's lower tail."""
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), z))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _statistics(x: Column) -> Column:
    token = F.rtrim(x["body"], F.lit("="))
    classes = F.translate(token, UPPER + LOWER + DIGIT + "+/_-", "U" * 26 + "l" * 26 + "d" * 10 + "ssss")
    encoding = F.when(token.rlike("^[0-9a-fA-F]+$"), 16).when(token.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(encoding == 16, F.upper(token)).otherwise(token).alias("token"), classes.alias("classes"), encoding.alias("encoding"), F.length(token).cast("double").alias("n"))


def _tested(x: Column) -> Column:
    n, token, classes = x["n"], x["token"], x["classes"]
    squares = F.aggregate(F.array_distinct(F.split(token, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    values = F.transform(F.split(classes, ""), lambda c: F.when(c == "U", 2.0).when(c == "l", 0.0).otherwise(1.0))
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "encoding", "n")), squares.alias("squares"), values.alias("values"), runs.alias("runs"))


def _moments(x: Column) -> Column:
    mean = F.aggregate(x["values"], F.lit(0.0), lambda a, v: a + v) / x["n"]
    off = F.transform(x["values"], lambda v: v - mean)
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "encoding", "n", "squares", "runs")), off.alias("off"))


def _fisher(*p: Column) -> Column:
    """The negative logarithm of the three p-values' product tail."""
    total = -reduce(lambda a, b: a + b, (F.ln(F.greatest(x, F.lit(1e-12))) for x in p))
    return bind(total, lambda t: t - F.ln(1 + t + t * t / 2))


def _measured(x: Column) -> Column:
    """Chi-squared over the encoding's cells, share of class changes and lag-one correlation of a string."""
    n, cells = x["n"], x["encoding"].cast("double")
    length = F.size(x["off"])
    around = F.aggregate(F.zip_with(F.slice(x["off"], F.lit(1), length - 1), F.slice(x["off"], F.lit(2), length - 1), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate(x["off"], F.lit(0.0), lambda a, v: a + v * v)
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "encoding", "n")), cells.alias("cells"), (cells * x["squares"] / n - n).alias("chi"), ((x["runs"] - 1) / (n - 1)).alias("changes"), (around / square).alias("correlation"))


def _p_value(x: Column) -> Column:
    n, cells, root = x["n"], x["cells"], F.sqrt(x["n"])
    of = [F.when(x["encoding"] == 16, a).when(x["encoding"] == 32, b).otherwise(c) for a, b, c in zip(*(NAMES[m] + (CHANGES[m],) for m in NAMES), strict=True)]
    coincidence, coincidence_spread, changes, changes_spread, correlation, correlation_spread, even = of
    # what a uniform string has: chi-squared around its degrees of freedom, changes and correlation on both sides
    free = cells - 1
    chi = _normal((free - x["chi"]) / F.sqrt(2 * free * (n - 1) / n))
    run = 2 * _normal(-F.abs(x["changes"] - even) * F.sqrt((n - 1) / (even * (1 - even))))
    serial = 2 * _normal(-F.abs(x["correlation"] + 1 / n) * root)
    uniform = _fisher(chi, run, serial) <= -math.log(UNLIKE)
    # what a name has
    chi = _normal((x["chi"] - cells * ((n - 1) * coincidence + 1) + n) * root / (cells * (n - 1) * coincidence_spread))
    run = _normal((changes - x["changes"]) * root / changes_spread)
    serial = _normal((x["correlation"] - correlation) * root / correlation_spread)
    key = x["encoding"] * 100 + F.floor(F.log2(n)).cast("int")
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), key.alias("class"), F.when(uniform, F.floor(_fisher(chi, run, serial) * BIN).cast("int")).otherwise(0).alias("bin"))


def _long(least: int) -> Callable[[Column], Column]:
    return lambda x: F.length(x["body"]) >= least


def _spans(found: Column, kind: int, name: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), F.lit(name).alias("name"))).cast(SPAN)


def apart(x: Column, spans: Column) -> Column:
    """Whether x meets none of the spans, which are sorted by start: cells of spans are tried first."""

    def cells(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        last = F.floor((F.size(v) - 1) / width).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda k: F.slice(v, k * width + 1, width))
        return F.transform(parts, lambda c: F.struct(F.get(c["start"], 0).alias("start"), F.array_max(c["end"]).alias("end"), c.alias("spans")))

    meets = lambda b, y: (b["start"] < y["end"]) & (y["start"] < b["end"])
    return bind(F.struct(x.alias("x"), bind(spans, cells).alias("cells")), lambda v: F.filter(v["x"], lambda y: ~F.exists(v["cells"], lambda c: meets(c, y) & F.exists(c["spans"], lambda b: meets(b, y)))))


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `base` spans and `tried` strings (start, end, class, bin of the p-value)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = [_spans(F.filter(matches(text, pattern, group), _long(least)), k, name) for k, (name, pattern, group, least) in enumerate(KINDS)]
    out = docs.withColumn("base", F.array_sort(F.concat(*base)))
    mixed = lambda x: x["body"].rlike("[0-9]").cast("int") + x["body"].rlike("[a-z]").cast("int") + x["body"].rlike("[A-Z]").cast("int") >= 2
    tokens = apart(F.filter(matches(text, CANDIDATE, 1), mixed), F.col("base"))
    tried = reduce(F.transform, (_statistics, _tested, _moments, _measured, _p_value), tokens)
    return out.withColumn("tried", tried)


def accepted(candidates: DataFrame) -> dict[int, int]:
    """For each class, the least bin that the Benjamini-Hochberg step accepts; a few rows reach the driver."""
    bins = candidates.select(F.explode("tried").alias("x")).groupBy("x.class", "x.bin").count().collect()
    found = {}
    for c in {r["class"] for r in bins}:
        own = sorted(((r.bin, r["count"]) for r in bins if r["class"] == c), reverse=True)
        tried, so_far = sum(n for _, n in own), 0
        for b, n in own:
            so_far += n
            if 2.718281828459045 ** (-b / BIN) * tried <= RATE * so_far:
                found[c] = b
    return found


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `base` and `spans`: array<struct<start, kind, end, name>>, by start, then kind."""
    return judged(common.written(with_candidates(docs, text_col), "candidates"))


def judged(candidates: DataFrame) -> DataFrame:
    """with_candidates() with `spans` instead of `tried`."""
    least = accepted(candidates)
    if least:
        limits = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
        random = F.filter("tried", lambda x: F.coalesce(x["bin"] >= F.try_element_at(limits, x["class"]), F.lit(False)))
        random = _spans(random, len(KINDS), "random")
    else:
        random = F.array().cast(SPAN)
    return candidates.withColumn("spans", F.array_sort(F.concat("base", random))).drop("tried")


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for each span, one for spans that overlap. Parts are taken from pages of PAGE code points,
    so a text with many spans is not read anew for each."""
    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def part(pages: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PAGE).cast("int")
        own = F.array_join(F.slice(pages, first + 1, F.ceil(b / PAGE).cast("int") - first), "")
        return F.when(b > a, F.substring(own, a - first * PAGE + 1, b - a)).otherwise("")

    def whole(v: Column) -> Column:
        gaps = running(v["spans"], lambda at, x: F.greatest(at, x["end"]), lambda at, x: F.struct(at.alias("from"), x["start"].alias("to"), (x["end"] > at).alias("new")), "struct<from:int,to:int,new:boolean>")
        before = F.transform(gaps, lambda x: F.when(x["new"] & (x["to"] >= x["from"]), F.concat(part(v["pages"], x["from"], x["to"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(before, ""), part(v["pages"], F.array_max(v["spans"]["end"]), v["n"]))

    return bind(F.struct(pages.alias("pages"), spans.alias("spans"), F.length(text).alias("n")), whole)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in `text` replaced by a mark (overlapping ones by one), and n_chars in step if it is there."""
    columns = docs.columns
    own = {c: f"_{k}" for k, c in enumerate(columns) if c in ("base", "tried", "spans")}  # clashing names stand aside
    found = scanned(docs.withColumnsRenamed(own))
    out = found.withColumn("text", F.when(F.size("spans") > 0, cut_out(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))).drop("base", "spans").withColumnsRenamed({v: k for k, v in own.items()})
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(columns)


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(name: str) -> Callable[[Column], Column]:
    return lambda x: x == name


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(common.table(spark, sf_dir, "documents"))
    found = judged(common.written(with_candidates(docs).drop("text"), "candidates"))
    counts = [F.size(F.filter(F.transform("base", lambda x: x["name"]), _is(name))).cast("long").alias(f"n_{name}") for name, *_ in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
