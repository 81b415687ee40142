"""Captured listing pages to the products of one or all brands.

All brands go through one plan: the shops' configurations meet the pages before anything is parsed,
each page is walked once by the specification of its own shop, and what was found is written once,
because two stages read it: stop rules and limits, which read only counts, and the product rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.functions.details import detail_records
from loomcat.operators.brands import small, tag_from_dimension
from loomcat.operators.enrich import enrich_products
from loomcat.operators.paging import apply_takes, category_quota, page_prefix, page_takes
from loomcat.operators.sets import merge_datasets
from loomcat.operators.tiles import extract_shop_tiles, extract_tiles
from loomcat.plans.dialects import Dialect, Registry
from loomcat.session import materialize

CATEGORY_KEYS = ["brand", "category"]
#: What a page carries of its shop's configuration.
SHOP_COLUMNS = ["brand_id", "base_url", "page_size", "product_limit", "n_categories", "detailed"]
PAGE_COLUMNS = [*CATEGORY_KEYS, "start", "ok", *SHOP_COLUMNS, "category_no", "dialect"]


def shop_rows(configs: DataFrame, dialects: list[Dialect], number: Column) -> DataFrame:
    """One row per shop that has a dialect: its settings, its selectors and its categories' places.

    ``configs`` may lack any column but ``brand``; a setting that is absent has its default, and
    without ``categories`` all categories of a shop count, in the order of their names.
    """
    present = dict(configs.dtypes)

    def setting(name: str, kind: str, default) -> Column:
        given = F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)
        return F.coalesce(given, F.lit(default)) if default is not None else given

    def selectors(dialect: Dialect) -> Column:
        own = {old: F.col(c) for c, old in dialect.configured.items() if c in present}
        if not own:
            return F.lit(None).cast("string")
        pairs = F.create_map(*(x for old, new in own.items() for x in (F.lit(old), new)))
        return F.to_json(F.map_filter(pairs, lambda _, new: new.isNotNull()))

    of_dialect = F.lit(None).cast("string")
    detailed = F.lit(False)
    for n, dialect in enumerate(dialects):
        of_dialect = F.when(F.col("dialect") == n, selectors(dialect)).otherwise(of_dialect)
        detailed = detailed | ((F.col("dialect") == n) & F.lit(dialect.detailed))
    count, places = setting("n_categories", "int", 1), F.lit(None).cast("map<string,int>")
    if "categories" in present:
        names = F.map_keys("categories")
        count = F.coalesce(F.size(names), count)
        places = F.map_from_arrays(names, F.transform(names, lambda _, i: i))
    return (
        configs.withColumn("dialect", number)
        .filter("dialect IS NOT NULL")
        .select(
            "brand",
            "dialect",
            setting("brand_id", "string", None).alias("brand_id"),
            setting("base_url", "string", "").alias("base_url"),
            setting("page_size", "int", 12).alias("page_size"),
            setting("product_limit", "int", 0).alias("product_limit"),
            count.alias("n_categories"),
            (detailed & setting("enhance_with_details", "boolean", False)).alias("detailed"),
            of_dialect.alias("selectors"),
            places.alias("places"),
        )
    )


def walk_pages(pages: DataFrame, shops: DataFrame, dialects: list[Dialect]) -> DataFrame:
    """Every page of a known shop and configured category, with its usable tiles in ``products``.

    Pages of other shops and categories are left out before parsing; failed pages are not parsed.
    """
    known = pages.select(*CATEGORY_KEYS, "start", "ok", "html").join(small(shops), "brand")
    placed = F.when(F.col("places").isNull(), 0).otherwise(F.element_at("places", F.col("category")))
    read = known.withColumns({"category_no": placed, "html": F.when(F.col("ok"), F.col("html"))})
    tiles = extract_shop_tiles(
        read.filter("category_no IS NOT NULL"),
        [dialect.tiles for dialect in dialects],
        PAGE_COLUMNS,
        F.col("dialect"),
        F.col("selectors"),
    )

    def usable(tile: Column) -> Column:
        found = F.lit(False)
        for n, dialect in enumerate(dialects):
            found = F.when(F.col("dialect") == n, dialect.usable(tile)).otherwise(found)
        return found

    kept = tiles.withColumn("products", F.filter("tiles", usable)).drop("tiles")
    return materialize(kept.withColumn("n_products", F.size("products")), "pages")


def extract_pages(pages: DataFrame, dialect: Dialect) -> DataFrame:
    """One row per page with its usable tiles in ``products`` and their number, without shops."""
    extracted = extract_tiles(pages, dialect.tiles, [*CATEGORY_KEYS, "start", "ok"])
    usable = extracted.withColumn("products", F.filter("tiles", dialect.usable)).drop("tiles")
    return usable.withColumn("n_products", F.size("products"))


def counted_pages(walked: DataFrame) -> DataFrame:
    """Pages that count under the stop rules, cut to their category's share and their shop's limit.

    A limit below the number of categories shares out to nothing, which means no share, and only
    the limit cuts. What counts is worked out on the pages' numbers alone and written; products
    are read once, in the join with it.
    """
    thin = walked.select(
        *CATEGORY_KEYS, "category_no", "start", "ok", "no_results", "n_products",
        "page_size", "product_limit", "n_categories",
    )
    kept = page_prefix(thin, F.col("page_size"), CATEGORY_KEYS)
    limit = F.col("product_limit")
    quota = category_quota(limit, F.col("n_categories"))
    order = ["category_no", "category"]
    takes = page_takes(kept.filter(limit > 0), F.col("page_size"), quota, limit, CATEGORY_KEYS, ["brand"], order)
    whole = kept.filter(limit <= 0).select(*CATEGORY_KEYS, "start", F.col("n_products").alias("take"))
    return apply_takes(walked, materialize(takes.unionByName(whole), "takes"), "products", CATEGORY_KEYS)


def page_products(pages: DataFrame, dialect: Dialect) -> DataFrame:
    """Product rows of pages that carry ``products`` and the brand's configuration."""
    named = [f.name for f in pages.schema["products"].dataType.elementType]
    own = ["pos", *(n for n in named if n in dialect.tiles.fields)]
    tiles = pages.select(
        "brand",
        "brand_id",
        "base_url",
        F.col("category").alias("page_category"),
        "start",
        F.inline("products"),
    )
    return dialect.products(tiles.select("brand", "brand_id", "base_url", "page_category", "start", *own))


def kept_pages(pages: DataFrame, configs: DataFrame, dialect: Dialect) -> DataFrame:
    """Pages of all brands of a dialect under the stop rules."""
    shops = shop_rows(configs, [dialect], F.lit(0))
    return page_prefix(walk_pages(pages, shops, [dialect]), F.col("page_size"), CATEGORY_KEYS)


def harvest(pages: DataFrame, configs: DataFrame, dialect: Dialect) -> DataFrame:
    """Products of all brands of a dialect under the stop rules, without limits."""
    return page_products(kept_pages(pages, configs, dialect), dialect)


def harvest_limited(
    pages: DataFrame, configs: DataFrame, dialect: Dialect, category_order: DataFrame | None = None
) -> DataFrame:
    """As ``harvest``, with each brand's product limit shared over its categories.

    ``category_order`` gives (brand, category, category_no) where ``configs`` has no categories.
    """
    walked = walk_pages(pages, shop_rows(configs, [dialect], F.lit(0)), [dialect])
    if category_order is not None:
        walked = walked.drop("category_no").join(category_order, CATEGORY_KEYS)
    return page_products(counted_pages(walked), dialect)


def harvest_all(
    pages: DataFrame,
    configs: DataFrame,
    registry: Registry,
    captures: DataFrame | None = None,
    brand_dim: DataFrame | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """Products of every registered brand: stop rules, shares, limits, details and brand ids.

    ``captures`` has (brand, sku, seq, body) of detail documents; they reach the products of shops
    that are configured to have them. ``brand_dim`` has (id, name, seq); a brand found there by
    name regardless of case tags its products, and its ``brand`` becomes empty. ``as_of`` is the
    day of the harvest, for the seasons of detail documents.
    """
    dialects = registry.dialects()
    shops = shop_rows(configs, dialects, registry.number())
    counted = counted_pages(walk_pages(pages, shops, dialects))
    found = []
    for n, dialect in enumerate(dialects):
        own = counted.filter(F.col("dialect") == n)
        if captures is None or not dialect.detailed:
            found.append(page_products(own, dialect))
            continue
        bases = shops.filter("detailed").select("brand", F.col("base_url").alias("_base"))
        wanted = captures.select("brand", "sku", "seq", "body").join(small(bases), "brand")
        details = detail_records(wanted, F.col("_base"), F.current_date() if as_of is None else as_of).drop("_base")
        products = page_products(own.filter("detailed"), dialect)
        found.append(enrich_products(products, details, within=("brand",)))
        found.append(page_products(own.filter(~F.col("detailed")), dialect))
    products = merge_datasets(found)
    return products if brand_dim is None else tag_from_dimension(products, brand_dim, "seq")
