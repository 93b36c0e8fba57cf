"""String scalars for descriptions: all native column expressions.

Python's string functions know all of Unicode's white space and letters, Java's patterns only ASCII's unless told, so
every pattern here runs with (?U), and strip() is a pattern rather than trim().
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNICODE = "(?U)"
#: Stringified nulls, upper and lower case alike (fixed values).
NULL_STRINGS = ("nan", "none", "null", "na", "n/a", "<na>", "nat", "nil", "#n/a")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, UNICODE + r"\s+", " "))


def delete(c: Column, patterns: Iterable[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, UNICODE + p, "")
    return c


def replace(c: Column, pairs: Mapping[str, str]) -> Column:
    r"""Pattern -> replacement, in order; \1 stands for a group."""
    for p, to in pairs.items():
        c = F.regexp_replace(c, UNICODE + p, re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$")))
    return c


def text_key(c: Column) -> Column:
    """What texts are matched by: lower case, white space collapsed; null is empty."""
    return collapse(F.lower(F.coalesce(c, F.lit(""))))


def blank_nulls(c: Column) -> Column:
    """Stringified nulls, and nulls, become empty."""
    return F.when(c.isNull() | F.lower(strip(c)).isin(*NULL_STRINGS), "").otherwise(c)


def longest_first(terms: Iterable[str]) -> list[str]:
    return sorted(set(terms), key=lambda t: (-len(t), t))


def quoted(term: str) -> str:
    """The term as a pattern that Java reads literally."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def whole_word(terms: Sequence[str]) -> str:
    """A pattern for any term as a whole word, longest first; without terms one that never matches."""
    return r"\b(?:" + "|".join(map(quoted, longest_first(terms))) + r")\b" if terms else "(?!x)x"


def expand(c: Column, mapping: Mapping[str, str]) -> Column:
    """Whole-word replacement in a single pass: no replacement is matched again, longer keys win."""
    if not mapping:
        return c
    parts = F.regexp_extract_all(c, F.lit(UNICODE + whole_word(list(mapping)) + r"|\w+|\W"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def words(c: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(c, UNICODE + r"\s+"), lambda x: x != "")


def keep_known(c: Column, known: Sequence[str], least: int = 2) -> Column:
    """Tokens of `least` characters or more whose upper-case form is known; for a small set."""
    have = F.array(*[F.lit(k) for k in known]).cast("array<string>")
    return F.array_join(F.filter(words(c), lambda x: (F.length(x) >= least) & F.array_contains(have, F.upper(x))), " ")


def first_word(c: Column) -> Column:
    """The first token without punctuation around it, in lower case."""
    return F.lower(F.btrim(F.coalesce(F.get(words(c), 0), F.lit("")), F.lit(".,;:!?\"'()[]{}")))


def may_be_word(c: Column) -> Column:
    return (F.length(c) > 2) & ~c.rlike(UNICODE + r"\d")


def drop_first_word(c: Column, flag: Column) -> Column:
    """Without the first token where the flag is 0; a single token leaves nothing."""
    return F.when(flag == 0, F.regexp_replace(c, UNICODE + r"^\s*\S+\s*", "")).otherwise(c)


def _code(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), UNICODE + r"\s+", "")


def marker(value: Column, prefix: str, levels: Sequence[int] = (), missing: str | None = None) -> Column:
    """An array of tokens: the prefix and the code; with levels one for each prefix length that the code has. A blank
    code has no token, or the `missing` one."""
    code = _code(value)
    if levels:
        tokens = [F.when(F.length(code) >= n, F.concat(F.lit(f"{prefix}{n}_"), F.substring(code, 1, n))) for n in levels]
    else:
        tokens = [F.when(code != "", F.concat(F.lit(prefix), code))]
    found = F.array_compact(F.array(*tokens))
    return F.when(code == "", F.array(F.lit(f"{prefix}{missing}"))).otherwise(found) if missing else found


def with_markers(text: Column, markers: Sequence[Column]) -> Column:
    return collapse(F.concat_ws(" ", *markers, F.coalesce(text, F.lit(""))))


def vendor_marker(text: Column, vendor: Column, prefix: str = "VND_") -> Column:
    return with_markers(text, [marker(vendor, prefix)])


# What the light recipe deletes, and what it replaces.
LIGHT_DELETE = (r"\bhttps?://\S+\b", r"[^\w\s/\-\.]")
LIGHT_REPLACE = {r"(?<=\d)\s*(?:X|BY)\s*(?=\d)": "X", r"\b(\d+)\s*(IN|FT|MM|CM)\b": r"\1\2"}


def light_clean(c: Column, lists: Sequence[Sequence[str]] = (), upper: bool = True, pairs: Mapping[str, str] = LIGHT_REPLACE, drop_digits: bool = False, least: int = 1) -> Column:
    """Upper case, deletions, list terms, replacements, digits, white space, short tokens, in this order."""
    c = F.coalesce(c, F.lit(""))
    c = delete(F.upper(c) if upper else c, LIGHT_DELETE)
    for terms in lists:
        c = F.regexp_replace(c, UNICODE + whole_word([t.upper() for t in terms] if upper else list(terms)), " ")
    c = replace(c, pairs)
    if drop_digits:
        c = F.regexp_replace(c, UNICODE + r"\b\d+\b", " ")
    c = collapse(c)
    return collapse(F.regexp_replace(c, UNICODE + rf"\b\w{{1,{least - 1}}}\b", " ")) if least > 1 else c
