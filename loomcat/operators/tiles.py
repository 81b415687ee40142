"""Listing pages to tiles.

The one stage that leaves the JVM: a page's HTML is walked in ``mapInArrow`` and comes back as one
row per page with an array of raw tile strings. Pages are independent, so the stage has no shuffle
and no state, and everything after it is native. Tags left open are closed with their ancestor, or
where the next list item, cell, row, option or block ends them by HTML's rules; a tag that the page
ends within takes the rest of the page with it. The walk takes time in proportion to the page.

A page that cannot hold a tile or a stop mark is told apart by the JVM and is not sent to Python.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PAGES_PER_BATCH = 256  # bounds the Python memory of one step; not a cap on pages
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT_TAGS = frozenset(["script", "style"])
HIDDEN_TEXT_TAGS = frozenset(["script", "style", "template"])
_SELF, _PARENT, _TEXT, _FOUND = "self", "parent", "text", "found"


class Field(NamedTuple):
    """One raw value of a tile.

    ``take`` is ``text`` or ``found`` for the first element matching ``selector``, otherwise an
    attribute name. ``selector`` may also be ``self`` (the tile) or ``parent`` (its parent).
    """

    selector: str
    take: str


class TileSpec(NamedTuple):
    root: str
    fields: dict[str, Field]
    stop: str = ".no-results"


def tile_type(*specs: TileSpec) -> T.StructType:
    """Fields of one tile, of all specifications together: strings, except ``found`` flags."""
    kinds: dict[str, T.DataType] = {"pos": T.IntegerType()}
    for spec in specs:
        for name, field in spec.fields.items():
            kind = T.BooleanType() if field.take == _FOUND else T.StringType()
            if kinds.setdefault(name, kind) != kind:
                raise ValueError(f"field {name!r} has two types")
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def configured(spec: TileSpec, selectors: dict[str, str]) -> TileSpec:
    """The specification with some of its selectors replaced."""
    fields = {n: f._replace(selector=selectors.get(f.selector, f.selector)) for n, f in spec.fields.items()}
    return spec._replace(root=selectors.get(spec.root, spec.root), fields=fields)


_COMPOUND = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?((?:[.#][\w-]+)*)")


class _Rule(NamedTuple):
    """One part of a selector: what the element must be, and what must stand above it."""

    needed: int
    child: bool
    bit: int
    tag: str | None
    classes: frozenset[str]
    id: str | None
    final: str | None


class _Selectors:
    """Selectors of tags, classes and ids, as descendants or children, matched by bits.

    Bit i of a selector says that its first i+1 parts are matched along the way from the root. Open
    elements hand all bits down; for a child, only those count that its parent set itself.
    """

    def __init__(self, selectors: list[str]):
        self.by_tag: dict[str, list[_Rule]] = {}
        self.by_class: dict[str, list[_Rule]] = {}
        self.by_id: dict[str, list[_Rule]] = {}
        bit = 1
        for selector in selectors:
            for alternative in selector.split(","):
                parts = re.sub(r"\s*>\s*", " >", alternative.strip()).split()
                needed = 0
                for i, part in enumerate(parts):
                    name = part.removeprefix(">")
                    compound = _COMPOUND.fullmatch(name)
                    if not name or not compound or (i == 0 and name != part):
                        raise ValueError(f"selector not supported: {selector!r}")
                    classes = re.findall(r"\.([\w-]+)", compound[2])
                    ids = re.findall(r"#([\w-]+)", compound[2])
                    tag = compound[1].lower() if compound[1] else None
                    final = selector if i == len(parts) - 1 else None
                    rule = _Rule(
                        needed, name != part, bit, tag, frozenset(classes), ids[0] if ids else None, final
                    )
                    if classes:
                        self.by_class.setdefault(classes[0], []).append(rule)
                    elif ids:
                        self.by_id.setdefault(ids[0], []).append(rule)
                    else:
                        self.by_tag.setdefault(tag, []).append(rule)
                    needed, bit = bit, bit << 1

    def match(
        self, tag: str, classes: Iterable[str], id_: str | None, inherited: int, parents: int
    ) -> tuple[int, list[str]]:
        """Bits the element sets itself, and the selectors it fits."""
        own, hits = 0, []
        rules = [*self.by_tag.get(tag, ()), *self.by_id.get(id_, ())]
        for css_class in classes:
            rules.extend(self.by_class.get(css_class, ()))
        for rule in rules:
            above = parents if rule.child else inherited
            if (
                above & rule.needed == rule.needed
                and rule.tag in (None, tag)
                and rule.id in (None, id_)
                and rule.classes.issubset(classes)
            ):
                own |= rule.bit
                if rule.final:
                    hits.append(rule.final)
        return own, hits


_ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*))?"""
_TOKEN = re.compile(
    rf"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?:[\s/=]+|{_ATTRIBUTE})*+)>"
    r"|(?:/?[a-zA-Z]|[!?]).*)",  # the page ends within this tag
    re.S,
)
_NAME_VALUE = re.compile(
    r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]*)))?"""
)
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW_TEXT_TAGS}
_IN_VALUE = re.compile(r"""=\s*[^\s"'>]+$""")  # the tag ends within an unquoted value
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))")

# The open elements that a start tag ends, and what it does not reach beyond.
_CELLS, _ROWS, _TABLE = ("td", "th"), ("td", "th", "tr"), frozenset(["table"])
_SECTIONS = (*_ROWS, "tbody", "thead", "tfoot")
_ENDS = {
    "li": (("li",), frozenset(["ul", "ol", "menu"])),
    "dt": (("dt", "dd"), frozenset(["dl"])),
    "dd": (("dt", "dd"), frozenset(["dl"])),
    "option": (("option",), frozenset(["select", "datalist"])),
    "optgroup": (("option", "optgroup"), frozenset(["select"])),
    "td": (_CELLS, _TABLE),
    "th": (_CELLS, _TABLE),
    "tr": (_ROWS, _TABLE),
    "tbody": (_SECTIONS, _TABLE),
    "thead": (_SECTIONS, _TABLE),
    "tfoot": (_SECTIONS, _TABLE),
}
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_AROUND_PARAGRAPH = frozenset("button caption html object table td template th".split())


def _decoded(match: re.Match) -> str:
    name = match[1]
    return unescape(match[0]) if name[0] == "#" else html5.get(name, match[0])


@lru_cache(maxsize=4096)
def _attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; the first of equal names counts, a bare name is empty.

    A character reference without its semicolon stays as it is before a letter, digit or ``=``, so
    that the parameters of an address are not taken for one.
    """
    found: dict[str, str] = {}
    for name, double, single, bare in _NAME_VALUE.findall(source):
        found.setdefault(name.lower(), _REFERENCE.sub(_decoded, double or single or bare))
    return found


class _TileWalker:
    """Collects the tiles of one page in one pass over its tags.

    Attributes and text are only decoded where a selector or an open capture wants them, which is
    what makes this stage affordable: it is the one that is not compiled.
    """

    def __init__(self, spec: TileSpec):
        self.spec = spec
        found: dict[str, list[tuple[str, str]]] = {}
        self.own, self.parents = [], []
        for name, field in spec.fields.items():
            if field.selector == _SELF:
                self.own.append((name, field.take))
            elif field.selector == _PARENT:
                self.parents.append((name, field.take))
            else:
                found.setdefault(field.selector, []).append((name, field.take))
        self.by_selector = found
        self.selectors = _Selectors([spec.root, spec.stop, *found])

    def read(self, html: str) -> tuple[list[dict], bool]:
        self.tiles: list[dict] = []
        self.open_tiles: list[tuple[int, dict, set]] = []  # depth, values, selectors seen
        self.captures: list[tuple[int, list[str], dict, str]] = []  # depth, pieces, values, name
        self.stack: list[tuple[str, int, str, int]] = []  # tag, mask, attribute text, own bits
        self.open: Counter[str] = Counter()  # open elements of each tag
        self.stopped = False
        position = 0
        while token := _TOKEN.search(html, position):
            if self.captures:
                self._data(html[position : token.start()])
            position = token.end()
            closing, tag, attributes = token.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._end(tag)
            else:
                self._start(tag, attributes)
                if tag in RAW_TEXT_TAGS:
                    end = _RAW_END[tag].search(html, position)
                    position = end.start() if end else len(html)
        if self.captures:
            self._data(html[position:])
        self._close_from(0)
        return self.tiles, self.stopped

    def _start(self, tag: str, attributes: str) -> None:
        stack, selectors = self.stack, self.selectors
        if tag in _ENDS:
            self._imply_end(*_ENDS[tag])
        if self.open["p"] and tag in _ENDS_PARAGRAPH:
            self._imply_end(("p",), _AROUND_PARAGRAPH)
        inherited, parents = (stack[-1][1], stack[-1][3]) if stack else (0, 0)
        own = 0
        opens = tag not in VOID_TAGS and not (attributes.endswith("/") and not _IN_VALUE.search(attributes))
        lowered = attributes.lower()
        if tag in selectors.by_tag or "class" in lowered or (selectors.by_id and "id" in lowered):
            values = _attributes(attributes) if attributes else {}
            classes = dict.fromkeys(values.get("class", "").split())
            own, hits = selectors.match(tag, classes, values.get("id"), inherited, parents)
            if hits:
                self._take(hits, attributes, len(stack), opens)
        if opens:
            stack.append((tag, inherited | own, attributes, own))
            self.open[tag] += 1

    def _imply_end(self, ended: tuple[str, ...], around: frozenset[str]) -> None:
        """End the outermost open element of the kinds ``ended`` within the nearest one of ``around``."""
        found, left = None, sum(self.open[tag] for tag in ended)
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth][0]
            if not left or tag in around:
                break
            if tag in ended:
                found = depth
                left -= 1
        if found is not None:
            self._cut(found)

    def _take(self, hits: list[str], source: str, depth: int, opens: bool) -> None:
        for _, values, seen in self.open_tiles:
            for selector in hits:
                if selector in seen or selector not in self.by_selector:
                    continue
                seen.add(selector)
                for name, take in self.by_selector[selector]:
                    if take == _FOUND:
                        values[name] = True
                    elif take != _TEXT:
                        values[name] = _attributes(source).get(take)
                    elif opens:
                        self.captures.append((depth, [], values, name))
                    else:
                        values[name] = ""
        if self.spec.stop in hits:
            self.stopped = True
        if self.spec.root in hits:
            self._open_tile(source, depth, opens)

    def _open_tile(self, source: str, depth: int, opens: bool) -> None:
        values: dict = {"pos": len(self.tiles)}
        for name, field in self.spec.fields.items():
            values[name] = False if field.take == _FOUND else None
        for name, take in self.own:
            values[name] = _attributes(source).get(take)
        if self.stack:
            for name, take in self.parents:
                values[name] = _attributes(self.stack[-1][2]).get(take)
        self.tiles.append(values)
        if opens:
            self.open_tiles.append((depth, values, set()))

    def _end(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self._cut(depth)
                return

    def _cut(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.open[element[0]] -= 1
        del self.stack[depth:]
        if self.captures or self.open_tiles:
            self._close_from(depth)

    def _close_from(self, depth: int) -> None:
        """Close every tile and text capture at or below ``depth``."""
        while self.open_tiles and self.open_tiles[-1][0] >= depth:
            self.open_tiles.pop()
        if any(capture[0] >= depth for capture in self.captures):
            for _, pieces, values, name in (c for c in self.captures if c[0] >= depth):
                values[name] = "".join(pieces).strip()
            self.captures = [c for c in self.captures if c[0] < depth]

    def _data(self, text: str) -> None:
        if text and self.stack[-1][0] not in HIDDEN_TEXT_TAGS:
            decoded = unescape(text)
            for capture in self.captures:
                capture[1].append(decoded)


#: References that may spell a letter, digit, hyphen or underscore of a class or id.
_SPELLED = ("&#", "&lowbar;", "&UnderBar;", "&fjlig;")


def _mark(selector: Column) -> Column:
    """A class or id that an element must have to match; empty if there is no single one."""
    single = F.when(~selector.contains(","), F.regexp_extract(selector, r"[.#]([\w-]+)[^\s>]*$", 1))
    return F.coalesce(single, F.lit(""))


def worth_reading(html: Column, root: Column, stop: Column) -> Column:
    """Whether a page may hold an element matching either selector; told without parsing it."""
    may = [html.contains(_mark(root)), html.contains(_mark(stop)), *(html.contains(x) for x in _SPELLED)]
    found = may[0]
    for other in may[1:]:
        found = found | other
    return found


def extract_tiles(pages: DataFrame, spec: TileSpec, keys: list[str]) -> DataFrame:
    """Pages with an ``html`` column to one row per page: keys, no_results and ``tiles``.

    A page without a body has no tiles. Only the key columns and the HTML cross into Python.
    """
    return extract_shop_tiles(pages, [spec], keys, F.lit(0), F.lit(None).cast("string"))


def extract_shop_tiles(
    pages: DataFrame, specs: list[TileSpec], keys: list[str], number: Column, selectors: Column
) -> DataFrame:
    """As ``extract_tiles``, with a specification chosen for each page, in one walk over all pages.

    ``number`` tells the page's specification and ``selectors`` is a JSON object of the selectors
    that the page's shop replaces in it, by those they replace. A worker compiles each distinct
    specification once. A selector that is not supported gives pages without tiles, as a page that
    cannot be read does, and leaves other shops alone. Tiles have the fields of all specifications.
    """
    shape = tile_type(*specs)
    roots = F.element_at(F.array(*(F.lit(s.root) for s in specs)), number + 1)
    own = F.from_json(selectors, "map<string,string>")
    root = F.coalesce(F.element_at(own, roots), roots)
    stop = F.element_at(F.array(*(F.lit(s.stop) for s in specs)), number + 1)
    inputs = pages.select(
        *keys,
        F.when(worth_reading(F.col("html"), root, stop), F.col("html")).alias("_html"),
        number.cast("int").alias("_spec"),
        selectors.alias("_selectors"),
    )
    key_fields = [inputs.schema[key] for key in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("no_results", T.BooleanType()),
            T.StructField("tiles", T.ArrayType(shape)),
        ]
    )
    arrow_tiles = pa.list_(to_arrow_type(shape))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=1024)
        def walker(spec: int, replaced: str | None) -> _TileWalker | None:
            try:
                return _TileWalker(configured(specs[spec], json.loads(replaced or "{}")))
            except ValueError:
                return None

        def read(html: str | None, spec: int, replaced: str | None) -> tuple[list[dict], bool]:
            reader = walker(spec, replaced) if html else None
            return reader.read(html) if reader else ([], False)

        for whole in batches:
            for first in range(0, whole.num_rows, PAGES_PER_BATCH):
                batch = whole.slice(first, PAGES_PER_BATCH)
                chosen = zip(batch["_spec"].to_pylist(), batch["_selectors"].to_pylist(), strict=True)
                found = [read(html.as_py(), *of) for html, of in zip(batch["_html"], chosen, strict=True)]
                tiles = pa.array([page_tiles for page_tiles, _ in found], arrow_tiles)
                stopped = pa.array([stop for _, stop in found], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(key) for key in keys), stopped, tiles],
                    names=[*keys, "no_results", "tiles"],
                )

    return inputs.mapInArrow(walk, schema)


def explode_tiles(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per tile; pages without tiles give none."""
    return extracted.select(*keys, F.inline("tiles"))
