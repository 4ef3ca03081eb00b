"""Main text of web pages: the contiguous run of words and tags with the greatest sum.

A page is read into words and tags in order. Words count +1, tags a negative weight; one
linear scan finds the run with the greatest sum, and its words are the text. Words in elements
that by name, class, id or role are menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles or reader comments count nothing and are left out.

Weights are learnt from labelled pages: those that mark their content themselves with a
single ``article`` or ``main`` element. A tag's weight is minus the logarithm of how much more often it stands
outside the content than inside, over all labelled pages, at least ``LEAST`` and at most ``MOST``; tags of
running text always cost ``LEAST``. Only counts by tag name reach the driver, at most one line
for each known name. Extraction does not look at the labels.

The text: character references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one space. A tag without an end is dropped with what follows, as browsers do.

Defined results: a null or empty page, and one without such words, has an empty text; a null
url stays null; rows are independent, so ties and repeated rows are treated alike. Without
labelled pages all tags cost ``LEAST``. Other columns are not read."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import by_size, in_arrow

LEAST, MOST = 0.001, 3.0

#: Element names and words of class, id and role attributes by their use.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
BLOCKS = set("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template svg iframe textarea title object canvas math".split())
LEFT_OUT = set("nav header footer aside form button select dialog menu head audio video".split())
HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs toolbar header masthead footer comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe signup login search widget pagination pager skip copyright".split())
CONTENT_HINTS = set("article content main post entry story text".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Attributes one after the other, so that what looks like one inside a quoted value is not taken.
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'/=>]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_VALUE = re.compile(r"""\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+|(?=>))""")
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_SPLIT = re.compile(r"[\s_-]+")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


def tag_end(page: str, at: int, stuck: set[int]) -> int:
    """Where the tag at ``at`` ends: the first ``>`` outside quoted values, or just the first one if a
    quote is never closed; -1 if none. ``stuck`` has the equals signs of this page from which no end
    is found, so that all its tags together are read in linear time."""
    first = end = page.find(">", at)
    seen = []
    while end >= 0:
        equals = page.find("=", at, end)
        if equals < 0:
            return end
        seen.append(equals)
        value = None if equals in stuck else _VALUE.match(page, equals + 1)
        if value is None:
            break
        at = value.end()
        if at > end:
            end = page.find(">", at)
    stuck.update(seen)
    return first


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): kind is text, open or close; content is the text or attributes."""
    at, stuck = 0, set()
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        following = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                return
            at = end + 3
        elif following in ("!", "?"):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
        elif m := _NAME.match(page, start):
            end = tag_end(page, start, stuck)
            if end < 0:
                return
            name = m[1].lower()
            at = end + 1
            if following == "/":
                yield "close", name, ""
                continue
            yield "open", name, page[m.end() : end]
            if name in RAW and not page[start:end].endswith("/"):
                found = _RAW_END[name].search(page, at)
                if found is None:
                    return
                at = found.start()
        else:  # a lone bracket is text
            yield "text", "", "<"
            at = start + 1


def left_out(name: str, attributes: str, in_content: bool) -> str:
    """Why an element is not content: its own name or the word that says so; else empty."""
    if name in LEFT_OUT and not (name == "header" and in_content):
        return name
    if name in ("html", "body", "main") or name in INLINE and name != "span":
        return ""
    for key, value in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in ("class", "id", "role"):
            continue
        words = set(_SPLIT.split(value.strip("\"'").lower()))
        if key == "role":
            if words & ROLES:
                return "role"
        elif words & HINTS and not words & CONTENT_HINTS:
            return "comment" if words & {"comment", "comments", "disqus", "respond", "reply", "replies"} else "hint"
    return ""


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, counts, labelled): text counts if no element around it is left out;
    labelled says whether it stands in an ``article`` or ``main``."""
    outside, depth, reason = "", 0, ""  # the element that is left out, how often it is open, why
    content = 0
    for kind, name, value in pieces(page):
        if kind == "text":
            yield "text", value, not outside, content > 0
            continue
        closes = kind == "close"
        own = name in ("article", "main") and not outside
        if own and closes:
            content = max(0, content - 1)
        if outside:
            if not closes and name in ("article", "main") and reason != "comment" and not left_out(name, value, False):
                outside, own = "", True  # the element before was never closed
            elif name == outside:
                depth += -1 if closes else 1
                if depth == 0 or name in ("p", "li"):
                    outside = ""
                yield kind, name, False, content > 0
                continue
        if not outside and not closes and name not in VOID and name not in RAW:
            why = left_out(name, value, content > 0)
            if why:
                outside, depth, reason = name, 1, why
        yield kind, name, not outside, content > 0
        if own and not closes and not outside:
            content += 1


def tag_counts(page: str | None) -> Counter:
    """(tag, inside) counts of a page that labels its content once; else nothing."""
    found, labels = Counter(), 0
    for kind, value, _, labelled in tokens(page or ""):
        if kind != "text":
            name = value if value in BLOCKS else "other"
            labels += kind == "open" and value in ("article", "main")
            if value not in INLINE:
                found[name, labelled] += 1
    return found if labels == 1 else Counter()


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Text of the run with the greatest sum."""
    blocks: list[list[str]] = [[]]
    total = best = 0.0
    start = first = last = 0  # of blocks: the current run's first, the best run's first and last
    for kind, value, counts, _ in tokens(page or ""):
        if kind == "text":
            if counts:
                blocks[-1].append(value)
                number = len(value.split())
                if number:
                    total += number
                    if total > best:
                        best, first, last = total, start, len(blocks)
            continue
        if value not in INLINE:
            blocks.append([])
            total -= weights.get(value if value in BLOCKS else "other", LEAST)
        else:
            total -= LEAST
        if total <= 0:
            total, start = 0.0, len(blocks) - 1
            if value in INLINE and blocks[-1]:
                blocks.append([])
                start += 1
    # inline tags cost next to nothing, so a block that a run reaches belongs to it as a whole
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks[first:last])
    return " ".join(t for t in texts if t)


def learnt(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of tags by the counts over all labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter()
            for page in batch.column(0):
                found.update(tag_counts(page.as_py()))
            names = [n for n, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(found.values(), pa.int64())], ["tag", "inside", "n"])

    part = in_arrow(pages.select(F.col(html_col).alias("html")), run, "tag string, inside boolean, n bigint")
    counts = part.groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"))
    return {r["tag"]: min(MOST, max(LEAST, math.log((r["outside"] + 1) / (r["inside"] + 1)))) for r in counts.collect()}


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """Per row: id, url and ``text``."""
    weights = learnt(pages, html_col) if weights is None else weights
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 2):
                text = [extract(p.as_py(), weights) for p in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], ["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return in_arrow(rows, run, f"id {kinds['id']}, url {kinds['url']}, text string").withColumnsRenamed({"id": id_col, "url": url_col})
