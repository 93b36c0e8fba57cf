"""HTML extraction by line-block distribution: text lengths over sliding windows of lines, from surge to dive.

Markup is stripped to lines, one a block. Scripts, styles, comments, forms and containers that are boilerplate by
their tag or role leave no text; outside an article they leave a gap of empty lines instead. So do containers with a
boilerplate word as class or id, unless they hold <article> or <main>, or, on pages without these, more text and a larger
window than all that shows. Window sums of the lines' lengths rise from nothing at a surge and fall to nothing at a dive;
the stretches between are the candidates. <article> and <main> are a prior: only their stretches are candidates, unless a
single stretch elsewhere is longer than all of them. Then stretches whose largest window reaches `SURGE` characters stay, or
else the largest one, and so do shorter ones between them. On pages without these tags lines that follow one another in one
plain container (div, section, td) belong together, and a gap parts them from the next container's: the container whose
stretches have most text, a headline's counting `HEADED` times, is the main one; of the others those stay whose largest window
reaches `SURGE` characters and `SHARE` of its, and no short ones between. A headline right before the first one stays. Pages are worked on where they lie; nothing is shuffled.

Defined cases: null and empty pages give an empty text; unclosed tags are closed by their parents' end; a page without
block text gives an empty text; repeated rows are extracted one by one; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolith.llm import common

WINDOW = 3
SURGE = 80
#: On pages without <article> and <main>: a stretch outside the main container stays if its largest window has this share of
#: the main one's.
SHARE = 0.5
#: How many times its text a container counts for that holds a headline.
HEADED = 4

# HTML's element names, by how they are treated, and words that name boilerplate containers.
GONE = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option textarea input dialog menu audio video title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
BOXES = frozenset("div section center main article td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NAMES = (
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead topbar "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations "
    "comment comments disqus reply replies respond login signup search pagination pager widget toolbar skip copyright"
).split()
#: Words that may stand beside these in a class or id: `main-nav`, but not `has-sidebar`.
PLAIN = "area bar block bottom box button buttons container global inner item items left links list main outer page panel right section site slot top unit widget wrap wrapper".split()
NAMED = regex.compile(r"(?:^|\s)(?:(?:" + "|".join(PLAIN) + r")[_-])*(?:" + "|".join(NAMES) + r")(?:[_-](?:" + "|".join(NAMES + PLAIN) + r"|\d+))*(?:$|\s)", regex.I).search
TAG = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|noscript)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(?:[a-zA-Z/][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+|[a-zA-Z/!?][^>]*+)>""",
    regex.S | regex.I,
)
NAME = regex.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)").match
ATTRIBUTE = regex.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", regex.I).findall


def _boilerplate(name: str, tag: str, inside: bool) -> int:
    """2 for boilerplate by tag or role, 1 by a class or id, else 0."""
    if name in GONE or name == "header" and not inside:
        return 2
    if name in ("article", "main", "body", "html") or "=" not in tag:
        return 0
    found = 0
    for key, *values in ATTRIBUTE(tag):
        value = "".join(values).strip()
        if key.lower() == "role" and value.lower() in ROLES:
            return 2
        if key.lower() != "role" and NAMED(value):
            found = 1
    return found


def _windows(text: list[str]) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum([len(t) for t in text], dtype=np.int64)])
    return total[np.minimum(np.arange(len(text)) + WINDOW, len(text))] - total[:-1]


def lines(page: str) -> tuple[list[str], list[bool], list[bool], list[int]]:
    """The page's lines in order (empty ones are gaps), whether each lies in an article, whether in a headline, and the number
    of the innermost plain container around it."""
    out: list[str] = []
    where: list[bool] = []
    head: list[bool] = []
    box: list[int] = []
    under: list[tuple[int, ...]] = []  # the containers named as boilerplate around a line
    freed: set[int] = set()  # those of them that hold an article
    count = 0
    parts: list[str] = []
    open_: list[tuple[str, bool, bool, tuple[int, ...], int]] = []  # name, boilerplate by tag, in an article, containers named so, box
    opened: Counter[str] = Counter()  # how many of each name are open
    hidden = inside = False
    named_in: tuple[int, ...] = ()
    boxes = in_box = 0

    def end_line() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text and not hidden:
            out.append(text)
            where.append(inside)
            head.append(bool(opened["h1"] or opened["h2"]))
            box.append(in_box)
            under.append(named_in)

    def gap(always: bool = False) -> None:
        if always or not inside:
            out.extend([""] * WINDOW)
            where.extend([False] * WINDOW)
            head.extend([False] * WINDOW)
            box.extend([in_box] * WINDOW)
            under.extend([()] * WINDOW)

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        named = NAME(tag)
        if not named or m[1]:
            continue
        closing, name = named[1], named[2].lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK or name in GONE:
            end_line()
        elif not closing and ("=" not in tag or not _boilerplate(name, tag, inside)):
            continue
        if closing:
            if opened[name]:
                end_line()
                while True:
                    was, *_ = open_.pop()
                    opened[was] -= 1
                    if was == name:
                        break
        elif name not in VOID and not tag.endswith("/>"):
            while open_ and open_[-1][0] == "p" and name in BLOCK or open_ and open_[-1][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                opened[open_.pop()[0]] -= 1
            hidden, inside, named_in, in_box = open_[-1][1:] if open_ else (False, False, (), 0)
            bad = 0 if hidden else _boilerplate(name, tag, inside)
            if bad:
                end_line()
                gap()
            own = named_in
            if bad == 1:
                count += 1
                own = (*named_in, count)
            if name in ("article", "main") and not hidden:
                freed.update(named_in)
            if name in BOXES:
                boxes += 1
                in_box = boxes
            open_.append((name, hidden or bad == 2, inside or name in ("article", "main"), own, in_box))
            opened[name] += 1
        before = inside
        hidden, inside, named_in, in_box = open_[-1][1:] if open_ else (False, False, (), 0)
        if before and not inside:
            gap()
        elif inside and not before:
            gap(True)
    parts.append(page[at:])
    end_line()
    if not any(where):
        while True:
            shown = [t for t, u in zip(out, under, strict=True) if freed.issuperset(u)]
            within: dict[int, list[str]] = {}
            for t, u in zip(out, under, strict=True):
                if len(left := [c for c in u if c not in freed]) == 1:
                    within.setdefault(left[0], []).append(t)
            size, peak = sum(map(len, shown)), max(_windows(shown), default=0)
            over = [(sum(map(len, v)), c) for c, v in within.items() if sum(map(len, v)) > size and max(_windows(v)) > max(peak, SURGE)]
            if not over:
                break
            freed.add(max(over)[1])
    on = [freed.issuperset(u) for u in under]
    return tuple([x for x, k in zip(column, on, strict=True) if k] for column in (out, where, head, box))


def _stretches(text: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the window sums surge and dive, and the largest one between."""
    window = _windows(text)
    on = window > 0
    surge = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
    dive = np.flatnonzero(on & ~np.concatenate([on[1:], [False]])) + 1
    if not len(surge):
        return surge, dive, surge
    return surge, dive, np.maximum.reduceat(window, np.stack([surge, dive], 1).ravel()[: 2 * len(surge) - (dive[-1] == len(window))])[::2]


def _parted(text: list[str], head: list[bool], box: list[int]) -> tuple[list[str], list[bool], list[int]]:
    """The lines with a gap wherever the container around them changes."""
    out: tuple[list, list, list] = ([], [], [])
    last = None
    for row in zip(text, head, box, strict=True):
        if row[0]:
            if last is not None and row[2] != last:
                for column, x in zip(out, ("", False, last), strict=True):
                    column.extend([x] * WINDOW)
            last = row[2]
        for column, x in zip(out, row, strict=True):
            column.append(x)
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    text, where, head, box = lines(page)
    if not text:
        return ""
    if not any(where):
        text, head, box = _parted(text, head, box)
    if any(where):
        inner = [t if w else "" for w, t in zip(where, text, strict=True)]
        outer = ["" if w else t for w, t in zip(where, text, strict=True)]
        longest = max((sum(map(len, outer[a:b])) for a, b in zip(*(x.tolist() for x in _stretches(outer)[:2]), strict=True)), default=0)
        if sum(map(len, inner)) >= longest:
            text = inner
    surge, dive, peaks = _stretches(text)
    if not len(surge):
        return ""
    if any(where):
        keep = peaks >= SURGE
        if not keep.any():
            keep = np.arange(len(peaks)) == peaks.argmax()
        first, last = np.flatnonzero(keep)[[0, -1]]
        keep[first:last] = True
    else:
        own = np.array([next(b for t, b in zip(text[a:z], box[a:z], strict=True) if t) for a, z in zip(surge.tolist(), dive.tolist(), strict=True)])
        sizes = np.array([sum(map(len, text[a:z])) for a, z in zip(surge.tolist(), dive.tolist(), strict=True)])
        headed = [any(h and t for h, t in zip(head[a:z], text[a:z], strict=True)) for a, z in zip(surge.tolist(), dive.tolist(), strict=True)]
        totals = np.bincount(own, sizes) * np.where(np.bincount(own, headed) > 0, HEADED, 1)
        main = own == totals.argmax()
        keep = (peaks >= SURGE) & (main | (peaks >= SHARE * peaks[main].max()))
        if not (keep & main).any():
            keep |= main & (peaks == peaks[main].max())
        first, last = np.flatnonzero(keep)[[0, -1]]
        keep[first:last] |= main[first:last]
    if first and not any(h and t for h, t in zip(head[surge[first] : dive[first]], text[surge[first] : dive[first]], strict=True)):
        keep[first - 1] = any(h and t for h, t in zip(head[surge[first - 1] : dive[first - 1]], text[surge[first - 1] : dive[first - 1]], strict=True))
    return "\n".join(t for a, b, k in zip(surge.tolist(), dive.tolist(), keep.tolist(), strict=True) if k for t in text[a:b] if t)


def extracted(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The keys of every page and its main text."""
    common.tune(pages.sparkSession)
    chosen = pages.select(*keys, F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in keys), "text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, "_html"):
            texts = [main_text(p) for p in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(texts, pa.string())], [*keys, "text"])

    return common.mapped(chosen, run, schema)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
