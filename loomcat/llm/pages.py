"""Main text of web pages by differencing with the nearest page of the same host.

Pages are ordered by host and URL path, so that the nearest pages by path are neighbours. The text
lines (blocks) of each page are aligned with those of its neighbours by a longest common
subsequence. Markup decides what neighbours cannot tell, since menus and adverts differ from page to
page and articles quote each other: blocks inside an article or main element are content, whatever
its class; blocks inside navigation, page headers and footers, sidebars, notices, adverts, forms and
comments are not, nor is unmarked text beside content that makes up the larger part of a page. All
other blocks go if a neighbour has them too. A neighbour that holds every such block is a copy of the
page, tells nothing, and is passed over.

Only hashes of lines travel between neighbours: the order is a distributed range sort, and each page
meets its neighbours in joins on the ordinal, whatever the size of a host. Pages are read in one pass,
also malformed ones of any length; a tag that a page ends within takes the rest with it. NULL html gives an empty
text, a NULL URL the host ""; repeated rows each get a row; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.llm.common import bound_batches
from loomcat.operators.reports import with_ordinal
from loomcat.session import materialize

# Element names by what they mean for a page's text.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NO_TEXT = set(
    "head title script style noscript template svg iframe object canvas audio video button select "
    "textarea label input datalist math".split()
)
_BESIDE = set("nav footer aside menu dialog".split())
_CONTENT = {"article", "main"}
# Words of class and id attributes, and roles, of what is not content.
_BESIDE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer masthead menu modal nav navbar navigation "
    "newsletter notice popup promo promotion related responses share sharing sidebar social sponsor "
    "sponsored subscribe toolbar widget".split()
)
_BESIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar form".split())

# What beside such a word in a class tells that the thing is absent or in some state.
_MODIFIERS = set("no not has have with without hide hidden is js can close closed open opened enabled disabled on off".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_PART = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Opening one of these closes an open one of the same group.
_SIBLINGS = {"p": "p", "li": "li", "dt": "d", "dd": "d", "td": "c", "th": "c", "tr": "r", "option": "o"}

_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
CONTENT, OPEN, BESIDE, FORM = "content", "open", "beside", "form"


def _tags(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """Markup of a page in one pass: begin, end, element name ("" for none), attributes, end tag or not.

    Quotes are heeded after ``=``. What the page ends within goes with the rest of the page; a quote that
    is never closed is a plain character. Scripts and styles are taken with their content.
    """
    at, last, unclosed = html.find("<"), len(html), set()
    while at >= 0:
        tag = _TAG.match(html, at)
        if not tag:
            if html.startswith("<!--", at):
                end = html.find("-->", at + 4)
                end = last if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), at):
                end = html.find(">", at + 2)
                end = last if end < 0 else end + 1
            else:
                at = html.find("<", at + 1)
                continue
            yield at, end, "", "", False
        else:
            name, part = tag[2].lower(), _TAG_PART.search(html, tag.end())
            while part and part[1]:
                close = -1 if part[1] in unclosed else html.find(part[1], part.end())
                if close < 0:
                    unclosed.add(part[1])
                    close = part.end() - 1
                part = _TAG_PART.search(html, close + 1)
            end = part.end() if part else last
            attributes = html[tag.end() : end - 1] if part else ""
            if name in _RAW and not tag[1] and part:
                close = _RAW[name].search(html, end)
                yield at, close.end() if close else last, "", "", False
                end = close.end() if close else last
            else:
                yield at, end, name if part else "", attributes, bool(tag[1])
        at = html.find("<", end)


class _Open:
    """The open elements with their zones (None: no text); finds the one to close without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str | None]] = []
        self._places: dict[str, list[int]] = defaultdict(list)

    def _kinds(self, name: str) -> Iterator[str]:
        yield name
        if name in _SIBLINGS:
            yield "sibling " + _SIBLINGS[name]
        elif name in _BLOCK:
            yield "wall"

    @property
    def zone(self) -> str | None:
        return self.stack[-1][1] if self.stack else OPEN

    def push(self, name: str, zone: str | None) -> None:
        for kind in self._kinds(name):
            self._places[kind].append(len(self.stack))
        self.stack.append((name, zone))

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            for kind in self._kinds(self.stack.pop()[0]):
                self._places[kind].pop()

    def end(self, name: str) -> None:
        if self._places[name]:
            self._cut(self._places[name][-1])

    def end_sibling(self, name: str) -> None:
        """Elements with an optional end tag end where the next of their kind begins."""
        places, walls = self._places["sibling " + _SIBLINGS[name]], self._places["wall"]
        if places and (not walls or walls[-1] < places[-1]):
            self._cut(places[-1])


def blocks(html: str) -> list[tuple[str, str]]:
    """The page's text blocks and their zones, in order."""
    found: list[tuple[str, str]] = []
    words: list[str] = []
    elements = _Open()
    zone: str | None = OPEN
    block_zone: str | None = OPEN

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        if text and block_zone:
            found.append((text, block_zone))
        words.clear()

    at = 0
    for begin, end, name, attributes, closing in _tags(html):
        if zone and begin > at:
            words.append(html[at:begin])
        at = end
        if not name:
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if closing:
            elements.end(name)
        else:
            if name in _SIBLINGS:
                elements.end_sibling(name)
            if name not in _VOID and not attributes.endswith("/"):
                elements.push(name, _zone(name, attributes, elements.zone))
        zone = elements.zone
        block_zone = zone if name in _BLOCK or not words else block_zone
    if zone:
        words.append(html[at:])
    flush()
    return _settled(found)


def _settled(found: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Zones in view of the whole page.

    A form around everything is the page, not a form. Text outside of marked content goes if the marked
    content is the larger part; otherwise only teasers are marked, and the neighbours decide.
    """
    zones = {zone for _, zone in found}
    form = OPEN if zones.isdisjoint((CONTENT, OPEN)) else BESIDE
    marked = sum(len(text) for text, zone in found if zone == CONTENT)
    unmarked = sum(len(text) for text, zone in found if zone == OPEN)
    other = BESIDE if marked and marked >= unmarked else OPEN
    return [(text, {FORM: form, OPEN: other}.get(zone, zone)) for text, zone in found]


def _zone(name: str, attributes: str, outer: str | None) -> str | None:
    if outer is None or name in _NO_TEXT:
        return None
    if outer == BESIDE or name in _BESIDE or (name == "header" and outer != CONTENT):
        return BESIDE
    if name in _CONTENT:
        return CONTENT
    if attributes and name not in ("html", "body"):
        for m in _NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                if value in _BESIDE_ROLES:
                    return BESIDE
                if value == "main":
                    return CONTENT
            elif any(map(_names_beside, value.split())):
                return BESIDE
    return FORM if name == "form" and outer != CONTENT else outer


def _names_beside(value: str) -> bool:
    """Whether a class or id names what is not content: ``sidebar-left``, ``site-footer``; not ``no-sidebar``."""
    parts = re.split(r"[^a-z0-9]+", value)
    return not _BESIDE_WORDS.isdisjoint(parts) and _MODIFIERS.isdisjoint(parts)


def common_lines(ours: list[int], theirs: list[int]) -> list[int]:
    """Places in ``ours`` of a longest common subsequence."""
    places: dict[int, list[int]] = defaultdict(list)
    for j in range(len(theirs) - 1, -1, -1):
        places[theirs[j]].append(j)
    ends: list[int] = []  # smallest end in theirs of a common subsequence of each length
    last: list[tuple] = []
    for i, line in enumerate(ours):
        for j in places.get(line, ()):
            n = bisect_left(ends, j)
            link = (i, last[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                last.append(link)
            else:
                ends[n] = j
                last[n] = link
    out = []
    link = last[-1] if last else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) >> 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, unsure = [], []
        for html in batch["html"].to_pylist():
            found = blocks(html or "")
            lines.append([_hash(text) for text, _ in found])
            unsure.append([zone == OPEN for _, zone in found])
        yield pa.record_batch(
            [
                *[batch[c] for c in ("page_id", "print", "host", "path")],
                pa.array(lines, pa.list_(pa.int64())),
                pa.array(unsure, pa.list_(pa.bool_())),
            ],
            names=["page_id", "print", "host", "path", "lines", "unsure"],
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of unsure lines that a neighbour shares."""
    for batch in batches:
        shared = []
        columns = (batch[c].to_pylist() for c in ("lines", "unsure", "before", "after"))
        for lines, unsure, *neighbours in zip(*columns, strict=True):
            places = {i for i, x in enumerate(unsure) if x}
            gone: set[int] = set()
            for other in neighbours if places else ():
                common = places.intersection(common_lines(lines, other or []))
                if common != places:
                    gone |= common
            shared.append(sorted(gone))
        yield pa.record_batch(
            [batch["page_id"], batch["print"], pa.array(shared, pa.list_(pa.int32()))],
            names=["page_id", "print", "shared"],
        )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, places = [], []
        for html in batch["html"].to_pylist():
            kept = [(text, i if zone == OPEN else -1) for i, (text, zone) in enumerate(blocks(html or "")) if zone != BESIDE]
            texts.append([text for text, _ in kept])
            places.append([i for _, i in kept])
        yield pa.record_batch(
            [
                batch["page_id"], batch["print"], batch["url"],
                pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32())),
            ],
            names=["page_id", "print", "url", "texts", "places"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` and ``n_shared`` (lines dropped as shared)."""
    bound_batches(pages.sparkSession)
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.select(
        "page_id", "url", "html", F.xxhash64("url", "html").alias("print"),
        F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )
    lines = rows.select("page_id", "print", "host", "path", "html").mapInArrow(
        _lines, "page_id long, print long, host string, path string, lines array<long>, unsure array<boolean>"
    )
    lines = materialize(lines, "page-lines")  # the sort samples its input, and would parse all pages twice
    placed = materialize(with_ordinal(lines, "host", "path", "page_id", "print"), "ordered-pages")

    def neighbour(name: str, step: int) -> DataFrame:
        return placed.select(
            (F.col("ordinal") - step).alias("ordinal"), F.col("host").alias(f"{name}_host"), F.col("lines").alias(name)
        )

    beside = (
        placed.join(neighbour("before", -1), "ordinal", "left")
        .join(neighbour("after", 1), "ordinal", "left")
        .select(
            "page_id", "print", "lines", "unsure",
            F.when(F.col("before_host") == F.col("host"), F.col("before")).alias("before"),
            F.when(F.col("after_host") == F.col("host"), F.col("after")).alias("after"),
        )
    )
    shared = (
        beside.mapInArrow(_compare, "page_id long, print long, shared array<int>")
        .filter(F.size("shared") > 0)
        .groupBy(F.col("page_id").alias("_id"), F.col("print").alias("_print"))
        .agg(F.max("shared").alias("shared"))
    )
    texts = rows.select("page_id", "print", "url", "html").mapInArrow(
        _texts, "page_id long, print long, url string, texts array<string>, places array<int>"
    )
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print"))
    kept = F.when(
        F.col("shared").isNull(), F.col("texts")
    ).otherwise(F.filter("texts", lambda x, i: ~F.array_contains("shared", F.get("places", i))))
    return (
        texts.join(shared, same, "left")
        .select("page_id", "url", F.array_join(kept, "\n\n").alias("text"), F.coalesce(F.size("shared"), F.lit(0)).alias("n_shared"))
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
    )
