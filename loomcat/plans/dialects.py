"""The two storefront dialects as tile specifications and DataFrame transforms.

Dialect A reads most of a product from its title and collection address. Dialect B reads a product
code, tag data on the parent element and, later, a detail document.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.functions import prices, titles, urls
from loomcat.functions.text import strip, to_double, words
from loomcat.operators.tiles import Field, TileSpec

# The elements of a listing page each dialect reads.
TILES_A = TileSpec(
    ".product-tile",
    {
        "tile_pid": Field("self", "data-pid"),
        "name": Field(".pdp-link a.link", "text"),
        "href": Field(".pdp-link a.link", "href"),
        "subtitle": Field(".subtitle", "text"),
        "price_raw": Field(".price .sales .value", "text"),
        "original_raw": Field(".price del .value", "text"),
        "primary_data_src": Field(".plp-dual-image img.tile-image", "data-src"),
        "primary_src": Field(".plp-dual-image img.tile-image", "src"),
        "hover_data_src": Field(".plp-dual-image img.hover-image", "data-src"),
        "hover_src": Field(".plp-dual-image img.hover-image", "src"),
        "sold_out": Field(".badge-wrapper .sold-out, .span-sold-out", "found"),
    },
)
TILES_B = TileSpec(
    ".product-tile",
    {
        "parent_pid": Field("parent", "data-pid"),
        "tile_pid": Field("self", "data-pid"),
        "tag_raw": Field("parent", "data-gtmdata"),
        "name": Field(".pdp-link .pdp-link-heading", "text"),
        "href": Field(".pdp-link a.link", "href"),
        "brand_text": Field(".product-brand .text-truncate", "text"),
        "price_raw": Field(".price .sales .value", "text"),
        "original_raw": Field(".price .strike-through .value", "text"),
    },
)
EMPTY_JSON_VALUES = ["null", "false", '""', "[]"]


def usable_tile_a(tile: Column) -> Column:
    """A tile needs a name element and a readable struck-out price."""
    return tile["name"].isNotNull() & ~prices.bad_original_price(tile["original_raw"])


def tag_data(raw: Column) -> Column:
    """Tag JSON as a map; NULL when it is no object."""
    return F.from_json(raw, "map<string,string>")


def usable_tile_b(tile: Column) -> Column:
    """A tile needs a name element, and tag data that is an object if its category is needed."""
    raw = strip(tile["tag_raw"])
    no_object = ~raw.startswith("{") & F.try_parse_json(raw).isNotNull()
    empty = raw.isin(EMPTY_JSON_VALUES) | F.coalesce(to_double(raw) == 0, F.lit(False))
    unreadable = F.coalesce(no_object & ~empty, F.lit(False))
    return tile["name"].isNotNull() & ~(
        unreadable & titles.category_from_name(tile["name"]).isNull()
    )


def products_a(tiles: DataFrame) -> DataFrame:
    """Raw dialect-A tiles with brand, brand_id and base_url to product rows."""
    url = urls.absolute_url(F.coalesce("href", F.lit("")), F.col("base_url"))
    staged = titles.with_title_fields(
        tiles.withColumns(
            {
                "url": url,
                "subtitle": F.coalesce("subtitle", F.lit("")),
                "price": prices.price_text(F.col("price_raw")),
            }
        )
    ).withColumns(
        {
            "_collection": urls.segment_after(F.col("url"), "collections"),
            "original_price": prices.original_price_text(F.col("original_raw"), F.col("price")),
        }
    ).withColumn(
        "discount_percentage", prices.discount_int(F.col("original_price"), F.col("price"))
    )
    url, subtitle, collection = F.col("url"), F.col("subtitle"), F.col("_collection")
    path_category = F.nullif(urls.category_from_collection(collection), F.lit(""))
    sku = F.coalesce(F.nullif("tile_pid", F.lit("")), urls.sku_from_product_path(url))
    return staged.select(
        *_kept(tiles),
        sku.alias("sku"),
        "name",
        titles.slug_a(F.col("name")).alias("slug"),
        "fabric_style",
        "fabric_type",
        "product_type",
        F.coalesce(path_category, subtitle).alias("category"),
        titles.season_from_text(subtitle).alias("collection"),
        urls.piece_info(collection).alias("piece_info"),
        "url",
        urls.image_pair(
            urls.lazy_image(F.col("primary_data_src"), F.col("primary_src")),
            urls.lazy_image(F.col("hover_data_src"), F.col("hover_src")),
        ).alias("img_url"),
        "price",
        "original_price",
        "discount_percentage",
        prices.on_sale_a(F.col("discount_percentage")).alias("on_sale"),
        (~F.col("sold_out")).alias("in_stock"),
    )


def products_b(tiles: DataFrame) -> DataFrame:
    """Raw dialect-B tiles with brand, brand_id and base_url to product rows.

    price and original_price are shown next to the product columns; the product itself, as stored
    and enriched, has none before its detail record.
    """
    listed = F.coalesce("parent_pid", "tile_pid", F.lit(""))
    url = urls.absolute_url(F.coalesce("href", F.lit("")), F.col("base_url"))
    staged = tiles.withColumns(
        {
            "url": url,
            "_words": words(F.col("name")),
            "_tags": tag_data(F.col("tag_raw")),
            "price": prices.price_text(prices.price_text_b(F.col("price_raw"))),
        }
    ).withColumn(
        "sku", F.coalesce(F.nullif(listed, F.lit("")), urls.sku_from_file_name(F.col("url")))
    )
    name = F.col("name")
    return staged.select(
        *_kept(tiles),
        "sku",
        "name",
        titles.slug_b(name, F.coalesce("brand_text", F.lit(""))).alias("slug"),
        titles.tail_product_type(F.col("_words")).alias("product_type"),
        titles.category_fallback(name, F.col("_tags"), F.col("page_category")).alias("category"),
        titles.colors_from_sku(F.col("sku")).alias("colors"),
        "url",
        "price",
        F.coalesce(prices.price_text_b(F.col("original_raw")), F.col("price")).alias(
            "original_price"
        ),
    )


PAGE_COLUMNS = ["brand", "brand_id", "page_category", "start", "pos"]


def _kept(tiles: DataFrame) -> list[str]:
    return [c for c in PAGE_COLUMNS if c in tiles.columns]


class Dialect(NamedTuple):
    """How one kind of storefront is read.

    ``configured`` names the configuration columns that a shop may set, each with the selector of
    ``tiles`` that it replaces. ``detailed`` storefronts have detail documents.
    """

    tiles: TileSpec
    usable: Callable[[Column], Column]
    products: Callable[[DataFrame], DataFrame]
    configured: dict[str, str] = {}
    detailed: bool = False


# The configuration columns that dialect B reads; dialect A reads none of its own.
CONFIGURED_B = {
    "product_selector": ".product-tile",
    "name_selector": ".pdp-link .pdp-link-heading",
    "product_brand_selector": ".product-brand .text-truncate",
    "pdp_link_selector": ".pdp-link a.link",
    "price_selector": ".price .sales .value",
    "original_price_selector": ".price .strike-through .value",
}
DIALECT_A = Dialect(TILES_A, usable_tile_a, products_a)
DIALECT_B = Dialect(TILES_B, usable_tile_b, products_b, CONFIGURED_B, detailed=True)


class Registry:
    """Brand name to dialect, ignoring case. A new brand is a registration and a configuration.

    A name may hold ``*`` for any characters, so that one entry covers a family of brands; the first
    registered match counts.
    """

    def __init__(self) -> None:
        self._dialects: dict[str, Dialect] = {}

    def register(self, brand: str, dialect: Dialect) -> None:
        self._dialects[brand.lower()] = dialect

    def get(self, brand: str) -> Dialect | None:
        for name, dialect in self._dialects.items():
            if re.fullmatch(_pattern(name), brand.lower(), re.S):
                return dialect
        return None

    def dialects(self) -> list[Dialect]:
        """The registered dialects, each once, in the order in which ``number`` counts them."""
        return [dialect for dialect, _ in self.groups()]

    def number(self) -> Column:
        """The number of the dialect that ``brand`` is registered for; NULL if there is none."""
        found = F.lit(None).cast("int")
        for n, (_, own) in enumerate(self.groups()):
            found = F.when(own, F.lit(n)).otherwise(found)
        return found

    def groups(self) -> list[tuple[Dialect, Column]]:
        """Each dialect with the condition on ``brand`` for its brands, which share one job."""
        grouped: dict[int, tuple[Dialect, Column]] = {}
        earlier = F.lit(False)
        for name, dialect in self._dialects.items():
            matches = F.lower("brand").rlike(rf"(?s)\A(?:{_pattern(name)})\z")
            own = matches & ~earlier
            earlier = earlier | matches
            known = grouped.get(id(dialect))
            grouped[id(dialect)] = (dialect, known[1] | own if known else own)
        return list(grouped.values())


def _pattern(name: str) -> str:
    return ".*".join(re.escape(part) for part in name.split("*"))
