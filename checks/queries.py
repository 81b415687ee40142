"""Every registered query with its comparison SQL.

A query reads the given tables, derives storefront inputs from them and runs the library. Its
comparison SQL computes the same rows from the values those inputs were made from.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from checks import views as v
from checks.views import AS_OF, BASE_B, duckdb_sql, spark_rows, table
from loomcat.functions import details, prices, seasons, titles, urls
from loomcat.functions.text import title_case, words
from loomcat.operators import brands, enrich, paging, projections, reports, sets
from loomcat.operators.dedup import last_per_key
from loomcat.operators.tiles import Field, TileSpec, explode_tiles, extract_tiles
from loomcat.plans import harvest as plans
from loomcat.plans import runs as run_plans
from loomcat.plans.dialects import DIALECT_A, DIALECT_B, TILES_A, TILES_B, Registry, tag_data
from loomcat.schemas import LISTING_ADDITIONS, PRODUCT_A, PRODUCT_B, RUNS
from loomcat.session import scratch_path
from loomcat.sinks import catalog
from loomcat.sinks import files as file_sinks
from loomcat.sources import files as file_sources
from loomcat.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        ORACLES[name] = duckdb_sql(sql)
        return function

    return register


def rule(name: str, view: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """A query that applies column rules to every row of a view, keyed by ``k``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark_rows(spark, sf_dir, f"SELECT * FROM {view}")
        return rows.select("k", *(c.alias(n) for n, c in columns().items()))

    query(name, f"SELECT k, {sql} FROM {view}")(run)


def piped(column: str | Column) -> Column:
    """Array as text, for engines that compare scalars."""
    return F.array_join(column, "|")


def piped_all(df: DataFrame) -> DataFrame:
    return df.select(
        *(piped(n).alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes)
    )


def round_2dp_sql(x: str) -> str:
    """Two decimals by exact binary value, ties to even, in the comparison engine."""
    cents = f"floor({x} * 100.0)"
    high = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    side = f"(({high} * 200.0 - ({cents} * 2 + 1)) + ({x} - {high}) * 200.0)"
    up = f"CASE WHEN {side} > 0 THEN 1 WHEN {side} < 0 THEN 0 ELSE abs({cents} % 2) END"
    return f"CAST(({cents} + {up}) / 100.0 AS DOUBLE)"


DISCOUNT_A = "CAST(round_even(off_x, 0) AS INT)"
DISCOUNT_B = f"CASE WHEN off_x IS NULL THEN CAST(0 AS DOUBLE) ELSE {round_2dp_sql('off_x')} END"
CREATED = "2026-01-02 03:04:05"


def moment(text: str = CREATED) -> Column:
    return F.lit(text).cast("timestamp")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def base_b() -> Column:
    return F.lit(BASE_B)


def shops(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Configuration of one dialect's shops, with their categories in order."""
    listed = spark_rows(spark, sf_dir, f"SELECT DISTINCT brand, page_category, cat_no FROM v{side}")
    categories = F.transform(
        F.array_sort(F.collect_list(F.struct("cat_no", "page_category"))),
        lambda c: F.struct(c["page_category"], c["cat_no"].cast("string")),
    )
    shown = listed.groupBy("brand").agg(F.map_from_entries(categories).alias("categories"))
    return spark_rows(spark, sf_dir, f"SELECT * FROM shops_{side}").drop("n_categories").join(shown, "brand")


def every_shop() -> Registry:
    registry = Registry()
    registry.register("SHOP_A_*", DIALECT_A)
    registry.register("SHOP_B_*", DIALECT_B)
    return registry


def tiles_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable dialect-A tiles without going through HTML, with their shop."""
    rows = spark_rows(spark, sf_dir, "SELECT va.*, 'id_' || brand AS brand_id FROM va WHERE usable_x")
    return rows.select(
        "k", "brand", "brand_id", F.lit(v.BASE_A).alias("base_url"), "page_category", "start",
        "pos", "tile_pid", "name", "href", "subtitle", "price_raw", "original_raw",
        F.expr("CASE pics WHEN 0 THEN '/i/' || k || '.jpg?sw=3' WHEN 2 THEN '' END").alias("primary_data_src"),
        F.expr("CASE pics WHEN 1 THEN '/i/' || k || '.jpg?sw=3' WHEN 2 THEN '/s/' || k || '.jpg' END").alias("primary_src"),
        F.expr("CASE pics WHEN 0 THEN '/i/' || k || 'b.jpg?sw=3' END").alias("hover_data_src"),
        F.lit(None).cast("string").alias("hover_src"),
        F.col("stock").isin(0, 5).alias("sold_out"),
    )


def tiles_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark_rows(spark, sf_dir, "SELECT vb.*, 'id_' || brand AS brand_id FROM vb WHERE usable_x")
    return rows.select(
        "brand", "brand_id", base_b().alias("base_url"), "page_category", "start", "pos",
        "parent_pid", "tile_pid", "tag_raw", "name", "href", "brand_text", "price_raw",
        "original_raw",
    )


def products_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DIALECT_A.products(tiles_a(spark, sf_dir)).select(*PRODUCT_A.fieldNames())


def products_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DIALECT_B.products(tiles_b(spark, sf_dir)).select(*PRODUCT_B.fieldNames())


def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.detail_records(v.captures(spark, sf_dir), BASE_B, as_of())


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_products(products_b(spark, sf_dir), detail_rows(spark, sf_dir))


def database(spark: SparkSession, label: str) -> catalog.CatalogDatabase:
    """A fresh database in the shared folder."""
    path = scratch_path(spark, label)
    return catalog.CatalogDatabase(spark, path.rsplit("/", 1)[1].replace("-", "_"), path)


# ---------------------------------------------------------------- tile extraction

TILE_KEYS = ["brand", "category", "start"]


def extracted(pages: DataFrame, spec: TileSpec) -> DataFrame:
    return extract_tiles(pages, spec, TILE_KEYS)


@query(
    "tile_extract",
    """SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
      tile_pid, CASE WHEN named THEN name END AS name, CASE WHEN named THEN href END AS href,
      subtitle, price_raw, trim(original_raw, ' ' || chr(10)) AS original_raw,
      CASE pics WHEN 0 THEN '/i/' || k || '.jpg?sw=300' WHEN 2 THEN '' END AS primary_data_src,
      CASE pics WHEN 1 THEN '/i/' || k || '.jpg?sw=300&q=1' WHEN 2 THEN '/s/' || k || '.jpg' END AS primary_src,
      CASE pics WHEN 0 THEN '/i/' || k || 'b.jpg?sw=300' END AS hover_data_src,
      CAST(NULL AS VARCHAR) AS hover_src, NOT in_stock_x AS sold_out FROM va""",
)
def tile_extract(spark, sf_dir):
    return explode_tiles(extracted(v.pages_a(spark, sf_dir), TILES_A), TILE_KEYS)


def unescaped_sql(text: str) -> str:
    """Character references of the given pages, which also cut some off before the semicolon."""
    for entity, character in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("#x27", "''"), ("#39", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{entity};?', '{character}', 'g')"
    return text


ARTICLES = TileSpec(
    "html", {"title": Field("title", "text"), "heading": Field("article h1", "text")}
)


@query(
    "tile_extract_web_pages",
    f"""SELECT page_id, {unescaped_sql("title")} AS title, {unescaped_sql("heading")} AS heading FROM (
      SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
      CASE WHEN html LIKE '%<h1%' THEN trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) END AS heading
      FROM pages) p""",
)
def tile_extract_web_pages(spark, sf_dir):
    found = extract_tiles(table(spark, sf_dir, "pages"), ARTICLES, ["page_id"])
    return explode_tiles(found, ["page_id"]).drop("pos")


@query(
    "tile_sku_attr",
    """SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
      CASE WHEN place < 2 THEN sku_full ELSE '' END AS sku FROM vb""",
)
def tile_sku_attr(spark, sf_dir):
    tiles = explode_tiles(extracted(v.pages_b(spark, sf_dir), TILES_B), TILE_KEYS)
    return tiles.select(
        *TILE_KEYS, "pos", F.coalesce("parent_pid", "tile_pid", F.lit("")).alias("sku")
    )


@query(
    "tile_gtm",
    """SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
      CASE WHEN odd_tag THEN NULL WHEN tag = 0 THEN 'Fabrics' WHEN tag = 1 THEN p_type END AS tag_category,
      CAST(CASE WHEN odd_tag OR tag IN (3, 4) THEN NULL WHEN tag = 2 THEN 0 WHEN tag = 1 THEN 2
        ELSE 1 END AS INT) AS tag_keys FROM vb""",
)
def tile_gtm(spark, sf_dir):
    tiles = explode_tiles(extracted(v.pages_b(spark, sf_dir), TILES_B), TILE_KEYS)
    tags = tag_data(F.col("tag_raw"))
    return tiles.select(
        *TILE_KEYS,
        "pos",
        tags["category"].alias("tag_category"),
        F.when(tags.isNotNull(), F.size(tags)).alias("tag_keys"),
    )


@query(
    "no_results_flag",
    """SELECT DISTINCT brand, page_category AS category, CAST(start AS INT) AS start, no_results FROM va""",
)
def no_results_flag(spark, sf_dir):
    return extracted(v.pages_a(spark, sf_dir), TILES_A).drop("tiles")


@query(
    "drop_nameless",
    "SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(n AS INT) AS n_products FROM page_counts_a",
)
def drop_nameless(spark, sf_dir):
    return plans.extract_pages(v.pages_a(spark, sf_dir), DIALECT_A).select(*TILE_KEYS, "n_products")


# ---------------------------------------------------------------- scalar rules, dialect A

rule("title_case", "va", lambda: {"label": title_case(F.concat(F.lower("w1"), F.lit("'s 2pc "), F.upper("w2")))},
     "w1 || chr(39) || 'S 2Pc ' || w2 AS label")
rule("title_grammar", "va", lambda: {}, "style_x AS fabric_style, fabric_x AS fabric_type, type_x AS product_type")
QUERIES["title_grammar"] = lambda spark, sf_dir: titles.with_title_fields(
    spark_rows(spark, sf_dir, "SELECT k, name FROM va")
).drop("name")
rule("compound_fabric", "va", lambda: {"fabric": titles.compound_fabric(words(F.col("name")), F.size(words(F.col("name"))))},
     "CASE form WHEN 4 THEN 'Raw Silk' WHEN 5 THEN 'Pima Cotton' END AS fabric")


def _collection_segment() -> Column:
    return urls.segment_after(F.col("href"), "collections")


rule("category_from_url", "va", lambda: {"category": urls.category_from_collection(_collection_segment())},
     "CASE WHEN path IN (4, 5, 6) THEN '' ELSE category_x END AS category")
rule("piece_info", "va", lambda: {"piece_info": urls.piece_info(_collection_segment())}, "piece_x AS piece_info")
rule("category_or_subtitle", "va",
     lambda: {"category": F.coalesce(F.nullif(urls.category_from_collection(_collection_segment()), F.lit("")), "subtitle")},
     "category_x AS category")
rule("season_from_subtitle", "va", lambda: {"collection": titles.season_from_text(F.col("subtitle"))}, "collection_x AS collection")
rule("slug_a", "va", lambda: {"slug": titles.slug_a(F.col("name"))},
     "replace(replace(lower(name), ' ', '-'), '--', '-') AS slug")
rule("absolute_url", "va", lambda: {"url": urls.absolute_url(F.col("href"), F.lit(v.BASE_A))}, "url_x AS url")
rule("sku_from_url_a", "va", lambda: {"sku": urls.sku_from_product_path(F.col("href"))},
     "CASE WHEN path < 6 THEN 'P' || k ELSE '' END AS sku")
rule("price_text_a", "va",
     lambda: {"price": prices.price_text(F.col("price_raw")),
              "original_price": F.when(~prices.bad_original_price(F.col("original_raw")),
                  prices.original_price_text(F.col("original_raw"), prices.price_text(F.col("price_raw"))))},
     "price_x AS price, CASE WHEN NOT bad_price THEN original_x END AS original_price")
rule("discount_int", "va", lambda: {"discount_percentage": prices.discount_int(F.col("original_x"), F.col("price_x"))},
     f"{DISCOUNT_A} AS discount_percentage")
rule("on_sale_a", "va", lambda: {"on_sale": prices.on_sale_a(prices.discount_int(F.col("original_x"), F.col("price_x")))},
     f"coalesce({DISCOUNT_A} > 0, false) AS on_sale")


@query("image_pick", "SELECT k, img_x AS img_url FROM va WHERE usable_x")
def image_pick(spark, sf_dir):
    first = urls.lazy_image(F.col("primary_data_src"), F.col("primary_src"))
    second = urls.lazy_image(F.col("hover_data_src"), F.col("hover_src"))
    return tiles_a(spark, sf_dir).select("k", piped(urls.image_pair(first, second)).alias("img_url"))


@query(
    "in_stock_a",
    """SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
      in_stock_x AS in_stock FROM va""",
)
def in_stock_a(spark, sf_dir):
    tiles = explode_tiles(extracted(v.pages_a(spark, sf_dir), TILES_A), TILE_KEYS)
    return tiles.select(*TILE_KEYS, "pos", (~F.col("sold_out")).alias("in_stock"))


# ---------------------------------------------------------------- scalar rules, dialect B

rule("tail_product_type", "vb", lambda: {"product_type": titles.tail_product_type(words(F.col("name")))}, "type_x AS product_type")
rule("category_from_name", "vb", lambda: {"category": titles.category_from_name(F.col("name"))}, "name_category_x AS category")
rule("category_fallback", "vb",
     lambda: {"category": titles.category_fallback(F.col("name"), tag_data(F.when(~F.col("odd_tag"), F.col("tag_raw"))), F.col("page_category"))},
     "coalesce(name_category_x, CASE WHEN odd_tag THEN CASE WHEN cat_no % 3 = 0 THEN 'Unstitched' ELSE page_category END ELSE listed_category_x END) AS category")
rule("slug_b", "vb", lambda: {"slug": titles.slug_b(F.col("name"), F.coalesce("brand_text", F.lit("")))}, "slug_x AS slug")
rule("color_from_sku", "vb", lambda: {"colors": piped(titles.colors_from_sku(F.col("sku_full")))}, "color_x AS colors")
rule("sku_from_url_b", "vb", lambda: {"sku": urls.sku_from_file_name(F.col("href"))},
     "CASE WHEN suffix <> '' THEN sku_full ELSE '' END AS sku")
rule("size_from_sku", "vb", lambda: {"size": urls.size_from_sku(F.col("sku_full"))}, "code_size_x AS size")
rule("price_text_b", "vb",
     lambda: {"price": prices.price_text(prices.price_text_b(F.col("price_raw"))),
              "original_price": F.coalesce(prices.price_text_b(F.col("original_raw")), prices.price_text(prices.price_text_b(F.col("price_raw"))))},
     "price_x AS price, original_x AS original_price")


@query(
    "strip_query",
    "SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN left(url, strpos(url, '?') - 1) ELSE url END AS url FROM pages",
)
def strip_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.strip_query(F.col("url")).alias("url"))


@query(
    "normalize_image_url",
    f"""SELECT page_id, '{BASE_B}' || split_part(regexp_replace(url, '^https?:/', ''), '?', 1) AS relative_url,
      split_part(url, '?', 1) AS absolute_url FROM pages""",
)
def normalize_image_url(spark, sf_dir):
    relative = F.regexp_replace("url", "^https?:/", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.normalize_image_url(relative, base_b()).alias("relative_url"),
        urls.normalize_image_url(F.col("url"), base_b()).alias("absolute_url"),
    )


# ---------------------------------------------------------------- detail documents

USABLE = "FROM vdy WHERE enriched_x"


def detail_query(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    """Columns of the usable, current detail records of all captured products."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detail_rows(spark, sf_dir).filter("seq = 2 AND usable").select("sku", *columns())

    query(name, f"SELECT sku_full AS sku, {sql} {USABLE}")(run)


@query(
    "detail_docs",
    """SELECT sku_full AS sku, CAST(2 AS BIGINT) AS seq, enriched_x AS usable FROM vdx WHERE captured
      UNION ALL SELECT sku_full, CAST(1 AS BIGINT), true FROM vdx WHERE captured AND k % 7 = 0""",
)
def detail_docs(spark, sf_dir):
    path = scratch_path(spark, "captures")
    v.captures(spark, sf_dir).write.parquet(path)
    records = details.detail_records(file_sources.detail_docs(spark, path), BASE_B, as_of())
    return records.select("sku", "seq", "usable")


PRICE_SQL = f"""current_x AS price_current, CASE WHEN original_d_x = 0 THEN current_x ELSE original_d_x END AS price_original,
  {DISCOUNT_B} AS discount_percentage"""
detail_query(
    "detail_price",
    lambda: [F.col(c) for c in ("price_current", "price_original", "discount_percentage", "is_sale")],
    f"{PRICE_SQL}, coalesce(current_x < nullif(original_d_x, 0), false) AS is_sale",
)
detail_query("detail_stock", lambda: [F.col("in_stock"), F.col("remaining_stock")],
             "in_stock_x AS in_stock, CAST(remaining_x AS INT) AS remaining_stock")
detail_query("collection_label", lambda: [F.col("collection")],
             "CASE WHEN shown_season_x IS NULL THEN 'Collection' ELSE shown_season_x || ' 2026' END AS collection")
detail_query("launch_time", lambda: [F.col("launch_time")], "launch_time_x AS launch_time")
detail_query("image_order", lambda: [piped("images").alias("images")], "images_x AS images")
detail_query("variation_values", lambda: [piped("colors").alias("colors"), piped("sizes").alias("sizes")],
             "colors_x AS colors, sizes_x AS sizes")
detail_query("detail_category", lambda: [F.col("category")], "d_category_x AS category")
FABRIC_SQL = """CASE WHEN has_doc AND has_custom THEN 'Lawn | Cotton' ELSE '' END AS top_fabric, '' AS bottom_fabric,
  '' AS dupatta_fabric, CASE WHEN has_doc AND has_custom THEN 'Raw  Silk' ELSE '' END AS main_fabric,
  CASE WHEN has_doc AND has_custom THEN 'A|B' ELSE '' END AS material, '' AS technique"""
detail_query("fabric_details", lambda: [F.col("fabric_details.*")], FABRIC_SQL)
detail_query(
    "detail_record",
    lambda: [
        *(F.col(c) for c in ("name", "product_type", "category", "long_description", "rating", "is_new", "launch_time", "product_concept")),
        piped("short_description").alias("short_description"),
        F.col("metadata.product_name").alias("metadata_name"),
        F.col("metadata.rating").alias("metadata_rating"),
        (F.length("raw_data") > 0).alias("has_raw_data"),
    ],
    """d_name_x AS name, d_type_x AS product_type, d_category_x AS category, long_x AS long_description,
      rating_x AS rating, is_new_x AS is_new, launch_time_x AS launch_time, concept_x AS product_concept,
      short_x AS short_description, d_name_x AS metadata_name, rating_x AS metadata_rating, true AS has_raw_data""",
)


@query(
    "launch_month",
    "SELECT k, CAST(CASE WHEN launch_form < 5 THEN m END AS INT) AS month FROM vd",
)
def launch_month(spark, sf_dir):
    rows = spark_rows(spark, sf_dir, "SELECT * FROM vd")
    return rows.select("k", seasons.launch_month(F.expr(v.LAUNCH)).alias("month"))


rule("season_of_month", "vdx", lambda: {"season": seasons.season_of_month(F.col("month_x"))}, "month_season_x AS season")


@query(
    "image_dedup",
    """SELECT page_id, unnest([split_part(url, '?', 1), 'https://other.example/second.jpg']) AS url FROM pages""",
)
def image_dedup(spark, sf_dir):
    """Each page's own address, the same file elsewhere, and another file twice: the first ones stay."""
    bare = urls.strip_query(F.col("url"))
    name = F.substring_index(bare, "/", -1)
    second = F.lit("https://other.example/second.jpg")
    listed = F.array(bare, F.concat(F.lit("https://mirror.example/"), name), second, F.lit("/x/second.jpg"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(details.image_dedup(listed)).alias("url"))


@query(
    "size_value",
    "SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS size, c_name AS kept FROM customer",
)
def size_value(spark, sf_dir):
    padded = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", details.size_value(padded).alias("size"), details.size_value(F.col("c_name")).alias("kept")
    )


WORDS_SQL = r"regexp_extract_all(replace(text, '|', ''), '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')"


@query(
    "words_array",
    f"""SELECT doc_id, CAST(len({WORDS_SQL}) AS INT) AS n_words, {WORDS_SQL}[1] AS first_word FROM documents""",
)
def words_array(spark, sf_dir):
    found = details.words_array(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(found).alias("n_words"), F.get(found, F.lit(0)).alias("first_word")
    )


@query(
    "last_per_key",
    "SELECT sku_full AS sku, CAST(2 AS BIGINT) AS seq FROM vd WHERE captured",
)
def latest_captures(spark, sf_dir):
    return last_per_key(v.captures(spark, sf_dir), ["sku"], "seq").select("sku", "seq")


# ---------------------------------------------------------------- enrichment

ENRICHED_VIEW = "(SELECT *, enriched_x AND sku_x <> '' AND suffix <> '' AS hit FROM vdy WHERE usable_x) e"


def enriched_query(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return enriched(spark, sf_dir).select("url", *columns())

    query(name, f"SELECT url_x AS url, {sql} FROM {ENRICHED_VIEW}")(run)


def hit(known: str, alias: str, kind: str | None = None) -> str:
    value = f"CAST({known} AS {kind})" if kind else known
    return f"CASE WHEN hit THEN {value} END AS {alias}"


ENRICHED_SQL = ", ".join(
    [
        "brand", "'id_' || brand AS brand_id", "sku_x AS sku", "slug_x AS slug", "type_x AS product_type",
        "CASE WHEN hit THEN d_name_x ELSE name END AS name",
        "CASE WHEN hit THEN enriched_category_x ELSE coalesce(name_category_x, listed_category_x) END AS category",
        "CASE WHEN hit THEN colors_x ELSE color_x END AS colors",
        hit("short_x", "short_description"), hit("long_x", "long_description"), hit("rating_x", "rating"),
        hit("is_new_x", "is_new"), hit("coalesce(current_x < original_d_x AND current_x > 0, false)", "is_sale"),
        hit("top_x", "top_fabric"), "CAST(NULL AS VARCHAR) AS bottom_fabric", "CAST(NULL AS VARCHAR) AS dupatta_fabric",
        hit("main_x", "main_fabric"), hit("material_x", "material"), "CAST(NULL AS VARCHAR) AS technique",
        hit("sizes_x", "sizes"),
        hit("CASE WHEN shown_season_x IS NULL THEN 'Collection' ELSE shown_season_x || ' 2026' END", "collection"),
        hit("launch_time_x", "launch_time"), hit("concept_x", "product_concept"), hit("current_x", "price_current"),
        hit("CASE WHEN original_d_x = 0 THEN current_x ELSE original_d_x END", "price_original"),
        hit(DISCOUNT_B, "discount_percentage"), hit("in_stock_x", "in_stock"), hit("remaining_x", "remaining_stock", "INT"),
        hit("true", "has_detailed_info"), hit("images_x", "img_url"),
    ]
)


@query("enrich_products", f"SELECT url_x AS url, {ENRICHED_SQL} FROM {ENRICHED_VIEW}")
def enrich_products(spark, sf_dir):
    return piped_all(enriched(spark, sf_dir))


enriched_query(
    "enriched_price",
    lambda: [F.col(c) for c in ("price_current", "price_original", "discount_percentage", "is_sale")],
    ", ".join([hit("current_x", "price_current"), hit("CASE WHEN original_d_x = 0 THEN current_x ELSE original_d_x END", "price_original"),
               hit(DISCOUNT_B, "discount_percentage"), hit("coalesce(current_x < original_d_x AND current_x > 0, false)", "is_sale")]),
)
enriched_query("enriched_category", lambda: [F.col("category")],
               "CASE WHEN hit THEN enriched_category_x ELSE coalesce(name_category_x, listed_category_x) END AS category")
enriched_query(
    "overwrite_rules",
    lambda: [F.col("name"), piped("colors").alias("colors"), piped("sizes").alias("sizes"), F.col("long_description")],
    "CASE WHEN hit THEN d_name_x ELSE name END AS name, CASE WHEN hit THEN colors_x ELSE color_x END AS colors, "
    + hit("sizes_x", "sizes") + ", " + hit("long_x", "long_description"),
)


@query("enriched_count", f"SELECT count(*) FILTER (WHERE hit) AS enriched, count(*) AS total FROM {ENRICHED_VIEW}")
def enriched_count(spark, sf_dir):
    return enrich.enriched_count(enriched(spark, sf_dir))


@query("launch_order", f"SELECT url_x AS url, {hit('launch_time_x', 'launch_time')} FROM {ENRICHED_VIEW} ORDER BY launch_time, url")
def launch_order(spark, sf_dir):
    return enrich.launch_order(enriched(spark, sf_dir).select("url", "launch_time"), "url")


SIZE_SQL = "CASE WHEN type_x = '3 Piece' THEN '3PC' WHEN type_x = '2 Piece' THEN '2PC' END"
REQUESTABLE = "usable_x AND sku_x <> '' AND suffix <> ''"


@query("detail_requests", f"SELECT sku_x AS id, color_x AS color, {SIZE_SQL} AS size FROM vb WHERE {REQUESTABLE}")
def detail_requests(spark, sf_dir):
    return enrich.detail_requests(products_b(spark, sf_dir))


PREFIX_SQL = "'dwvar_' || code || '__' || upper(color_x)"


@query(
    "request_manifest",
    f"""SELECT sku_x AS id, key, value FROM (
      SELECT *, {PREFIX_SQL} || '_color' AS key, upper(color_x) AS value FROM vb
      UNION ALL SELECT *, {PREFIX_SQL} || '_size', coalesce({SIZE_SQL}, code_size_x) FROM vb
      UNION ALL SELECT *, 'pid', sku_x FROM vb UNION ALL SELECT *, 'quantity', '1' FROM vb
      UNION ALL SELECT *, 'fromSizeSwatch', 'true' FROM vb) r WHERE {REQUESTABLE}""",
)
def request_manifest(spark, sf_dir):
    manifest = enrich.request_manifest(enrich.detail_requests(products_b(spark, sf_dir)))
    return manifest.select("id", F.explode("parameters"))


# ---------------------------------------------------------------- whole harvests

PRODUCT_A_SQL = f"""brand, 'id_' || brand AS brand_id, page_category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
  sku_x AS sku, name, replace(replace(lower(name), ' ', '-'), '--', '-') AS slug, style_x AS fabric_style,
  fabric_x AS fabric_type, type_x AS product_type, category_x AS category, collection_x AS collection,
  piece_x AS piece_info, url_x AS url, img_x AS img_url, price_x AS price, original_x AS original_price,
  {DISCOUNT_A} AS discount_percentage, coalesce({DISCOUNT_A} > 0, false) AS on_sale, in_stock_x AS in_stock"""
PRODUCT_B_SQL = """brand, 'id_' || brand AS brand_id, page_category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos,
  sku_x AS sku, name, slug_x AS slug, type_x AS product_type,
  coalesce(name_category_x, listed_category_x) AS category, color_x AS colors, url_x AS url,
  price_x AS price, original_x AS original_price"""


@query(
    "discounted_in_stock",
    f"""SELECT category, count(*) AS n_products, count(*) FILTER (WHERE piece_info <> '') AS n_with_pieces
      FROM (SELECT {PRODUCT_A_SQL} FROM kept_a) p WHERE on_sale AND in_stock GROUP BY category""",
)
def discounted_in_stock(spark, sf_dir):
    """Discounted products in stock per category, from captured pages."""
    products = plans.harvest(v.captured_a(spark, sf_dir), shops(spark, sf_dir, "a"), DIALECT_A)
    return (
        products.filter("on_sale AND in_stock")
        .groupBy("category")
        .agg(F.count("*").alias("n_products"), F.count_if(F.col("piece_info") != "").alias("n_with_pieces"))
    )


@query("harvest_a", f"SELECT {PRODUCT_A_SQL} FROM kept_a")
def harvest_a(spark, sf_dir):
    return piped_all(plans.harvest(v.captured_a(spark, sf_dir), shops(spark, sf_dir, "a"), DIALECT_A))


@query("harvest_b", f"SELECT {PRODUCT_B_SQL} FROM kept_b")
def harvest_b(spark, sf_dir):
    return piped_all(plans.harvest(v.captured_b(spark, sf_dir), shops(spark, sf_dir, "b"), DIALECT_B))


@query(
    "page_prefix",
    "SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(n AS INT) AS n_products FROM kept_pages_a",
)
def page_prefix(spark, sf_dir):
    return plans.kept_pages(v.captured_a(spark, sf_dir), shops(spark, sf_dir, "a"), DIALECT_A).select(
        *TILE_KEYS, "n_products"
    )


@query(
    "category_quota",
    """SELECT brand, page_category AS category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos FROM (
      SELECT a.*, CASE WHEN product_limit <= 0 THEN 0 WHEN n_categories <= 1 THEN product_limit
          ELSE CAST(floor(product_limit / n_categories) AS BIGINT) END AS quota,
        row_number() OVER (PARTITION BY a.brand, page_category ORDER BY start, pos) AS nth
      FROM kept_a a JOIN shops_a s ON a.brand = s.brand) q WHERE quota = 0 OR nth <= quota""",
)
def category_quota(spark, sf_dir):
    kept = plans.kept_pages(v.captured_a(spark, sf_dir), shops(spark, sf_dir, "a"), DIALECT_A)
    quota = paging.category_quota(F.col("product_limit"), F.col("n_categories"))
    cut = paging.apply_quota(kept, "products", F.col("page_size"), quota, ["brand", "category"])
    return cut.select(*TILE_KEYS, F.explode("products.pos").alias("pos"))


@query(
    "global_limit",
    """SELECT brand, page_category, CAST(start AS INT) AS start, CAST(pos AS INT) AS pos, sku_x AS sku FROM limited_b
      UNION ALL SELECT brand, page_category, CAST(start AS INT), CAST(pos AS INT), sku_x FROM limited_a""",
)
def global_limit(spark, sf_dir):
    limited = [
        plans.harvest_limited(v.captured_b(spark, sf_dir), shops(spark, sf_dir, "b"), DIALECT_B),
        plans.harvest_limited(v.captured_a(spark, sf_dir), shops(spark, sf_dir, "a"), DIALECT_A),
    ]
    return sets.merge_datasets([x.select("brand", "page_category", "start", "pos", "sku") for x in limited])


@query(
    "category_counts",
    """SELECT brand, page_category, n_products, CAST(sum(n_products) OVER (PARTITION BY brand ORDER BY page_category) AS BIGINT) AS running_total
      FROM (SELECT brand, page_category, count(*) AS n_products FROM kept_b GROUP BY brand, page_category) c""",
)
def category_counts(spark, sf_dir):
    products = plans.harvest(v.captured_b(spark, sf_dir), shops(spark, sf_dir, "b"), DIALECT_B)
    return paging.category_counts(products, ["brand", "page_category"], ["page_category"])


@query(
    "all_categories",
    "SELECT page_category, sku_x AS sku, name FROM vb WHERE usable_x UNION ALL SELECT 'sale', sku_x, name FROM vb WHERE usable_x",
)
def all_categories(spark, sf_dir):
    """The same products listed in their category and again in a second one: both stay."""
    listed = DIALECT_B.products(tiles_b(spark, sf_dir)).select("page_category", "sku", "name")
    return sets.merge_datasets([listed, listed.withColumn("page_category", F.lit("sale"))])


BRAND_HIT = "enhance_with_details AND enriched_x AND sku_x <> '' AND suffix <> ''"
ALL_BRANDS_SQL = f"""SELECT coalesce(CASE WHEN p.brand <> 'shop_a_1' THEN 'id_' || p.brand END, d.id) AS brand_id,
    CASE WHEN d.id IS NULL THEN p.brand END AS brand, sku, p.name, category, price, price_current, in_stock, launch_time,
    coalesce(has_detailed_info, false) AS has_detailed_info
  FROM (
    SELECT brand, sku_x AS sku, name, category_x AS category, price_x AS price, CAST(NULL AS DOUBLE) AS price_current,
      in_stock_x AS in_stock, NULL AS launch_time, false AS has_detailed_info FROM limited_a
    UNION ALL SELECT brand, sku_x, CASE WHEN hit THEN d_name_x ELSE name END,
      CASE WHEN hit THEN enriched_category_x ELSE coalesce(name_category_x, listed_category_x) END, price_x,
      CASE WHEN hit THEN current_x END, CASE WHEN hit THEN in_stock_d END, CASE WHEN hit THEN launch_time_x END, hit
    FROM (SELECT l.brand, l.k, sku_x, name, name_category_x, listed_category_x, price_x, d_name_x, enriched_category_x,
        current_x, in_stock_d, launch_time_x, {BRAND_HIT} AS hit
      FROM limited_b l JOIN shops_b s ON l.brand = s.brand
      JOIN (SELECT k AS dk, enriched_x, d_name_x, enriched_category_x, current_x, in_stock_x AS in_stock_d, launch_time_x
        FROM vdy) y ON l.k = dk) b
  ) p LEFT JOIN (SELECT * FROM shop_dim WHERE seq = 2) d ON lower(p.brand) = lower(d.name)"""


def whole_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shops of both dialects, with the details and ids that a harvest of all brands joins."""
    with v.shared_base(spark, sf_dir) as base:
        pages = sets.merge_datasets([v.captured_a(spark, sf_dir, base), v.captured_b(spark, sf_dir, base)])
        captures = v.captures(spark, sf_dir, "brand", base=base)
    shops_all = sets.merge_datasets([shops(spark, sf_dir, "a"), shops(spark, sf_dir, "b")])
    own_id = F.when(F.col("brand") != "shop_a_1", F.col("brand_id"))
    return plans.harvest_all(
        pages,
        shops_all.withColumn("brand_id", own_id),
        every_shop(),
        captures=captures,
        brand_dim=spark_rows(spark, sf_dir, "SELECT * FROM shop_dim"),
        as_of=as_of(),
    )


@query("all_brands", ALL_BRANDS_SQL)
def all_brands(spark, sf_dir):
    return whole_harvest(spark, sf_dir).select(
        "brand_id", "brand", "sku", "name", "category", "price", "price_current", "in_stock", "launch_time",
        F.coalesce("has_detailed_info", F.lit(False)).alias("has_detailed_info"),
    )


@query(
    "brand_transform",
    """SELECT brand, sku_x AS sku, name, slug_x AS slug, price_x AS price, original_x AS original_price, url_x AS url FROM kept_b
      UNION ALL SELECT brand, sku_x, name, replace(replace(lower(name), ' ', '-'), '--', '-'), price_x, original_x, url_x FROM kept_a""",
)
def brand_transform(spark, sf_dir):
    """Each shop read by its registered dialect and its own selectors; limits are lifted."""
    pages = sets.merge_datasets([v.captured_a(spark, sf_dir), v.captured_b(spark, sf_dir)])
    shops_all = sets.merge_datasets([shops(spark, sf_dir, "a"), shops(spark, sf_dir, "b")])
    found = plans.harvest_all(pages, shops_all.drop("product_limit"), every_shop())
    return found.select("brand", "sku", "name", "slug", "price", "original_price", "url")


# ---------------------------------------------------------------- projections and filters


@query(
    "tag_brand",
    "SELECT CASE WHEN path = 6 THEN 'given' ELSE 'id_' || brand END AS brand_id, sku_x AS sku, name FROM va WHERE usable_x",
)
def tag_brand(spark, sf_dir):
    own = F.when(F.col("url") != "", F.col("brand_id"))
    tagged = brands.tag_brand(products_a(spark, sf_dir).withColumn("brand_id", own), "given")
    return tagged.select("brand_id", "sku", "name")


@query(
    "listing_row",
    f"""SELECT 'id_' || brand AS brand_id, sku_x AS sku, name, type_x AS product_type, category_x AS category,
      collection_x AS collection, piece_x AS piece_info, '' AS fabric_slug, style_x AS fabric_style,
      fabric_x AS fabric_type, '' AS color, url_x AS url, '' AS primary_image_url, '' AS hover_image_url,
      '' AS image_url, price_x AS price, original_x AS original_price,
      CAST({DISCOUNT_A} AS DOUBLE) AS discount_percentage, coalesce({DISCOUNT_A} > 0, false) AS on_sale,
      in_stock_x AS in_stock, sku_x AS raw_sku FROM va WHERE usable_x
      UNION ALL SELECT 'id_' || brand, sku_x, name, type_x, coalesce(name_category_x, listed_category_x),
      '', '', '', '', '', '', url_x, '', '', '', '', '', NULL, false, true, sku_x FROM vb WHERE usable_x""",
)
def listing_row(spark, sf_dir):
    rows = sets.merge_datasets(
        [
            projections.listing_row(products_a(spark, sf_dir)),
            projections.listing_row(products_b(spark, sf_dir)),
        ]
    )
    return rows.withColumn("raw_sku", F.get_json_object("raw_data", "$.sku")).drop("raw_data")


@query(
    "product_row",
    f"""SELECT sku_x AS sku, CASE WHEN hit THEN d_name_x ELSE name END AS name, 'the-brand' AS brand_id, url_x AS url,
      slug_x AS slug, type_x AS type,
      CASE WHEN hit THEN enriched_category_x ELSE coalesce(name_category_x, listed_category_x) END AS category,
      CASE WHEN hit THEN colors_x ELSE color_x END AS colors, {hit("sizes_x", "sizes")}, {hit("short_x", "short_description")},
      {hit("long_x", "long_description")},
      {hit("CASE WHEN shown_season_x IS NULL THEN 'Collection' ELSE shown_season_x || ' 2026' END", "collection")},
      {hit("rating_x", "rating")}, {hit("is_new_x", "is_new")},
      {hit("coalesce(current_x < original_d_x AND current_x > 0, false)", "is_sale")}, {hit("material_x", "material")},
      CAST(NULL AS VARCHAR) AS technique, {hit("images_x", "img_url")}, {hit("true", "has_detaild_info")}
      FROM {ENRICHED_VIEW}""",
)
def product_row(spark, sf_dir):
    return piped_all(projections.product_row(enriched(spark, sf_dir), "the-brand"))


@query(
    "run_item_row",
    f"""SELECT 'run-1' AS scrape_id, brand, sku_x AS sku, name, type_x AS product_type, style_x AS fabric_style,
      fabric_x AS fabric_type, category_x AS category, '' AS color, url_x AS url, '' AS primary_image_url,
      '' AS hover_image_url, price_x AS price, original_x AS original_price,
      coalesce(CAST({DISCOUNT_A} AS VARCHAR), '') AS discount_percentage, '' AS status,
      slug_x AS stored_slug FROM (SELECT *, replace(replace(lower(name), ' ', '-'), '--', '-') AS slug_x FROM va) a
      WHERE usable_x""",
)
def run_item_row(spark, sf_dir):
    rows = projections.run_item_row(products_a(spark, sf_dir), F.lit("run-1"), F.col("brand"), moment())
    return rows.withColumn("stored_slug", F.get_json_object("scraped_data", "$.slug")).drop(
        "scraped_data", "created_at"
    )


@query("raw_payload", "SELECT to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size})::VARCHAR AS payload FROM part")
def raw_payload(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return rows.select(projections.raw_payload().alias("payload"))


@query("filter_rows", f"SELECT sku_x AS sku, url_x AS url FROM va WHERE usable_x AND {DISCOUNT_A} > 20 AND in_stock_x")
def filter_rows(spark, sf_dir):
    keep = (F.col("discount_percentage") > 20) & F.col("in_stock")
    return sets.filter_rows(products_a(spark, sf_dir), keep).select("sku", "url")


@query("filter_rows_python", "SELECT p_partkey, p_name FROM part WHERE p_size > 25 AND p_name LIKE '%ring%'")
def filter_rows_python(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    kept = sets.filter_rows(rows, lambda row: row["p_size"] > 25 and "ring" in row["p_name"])
    return kept.select("p_partkey", "p_name")


# ---------------------------------------------------------------- brands and configurations

CONFIG_SQL = """SELECT * FROM (
  SELECT c.*, 'new' AS layout, true AS preferred FROM config_files c WHERE in_new AND NOT broken_new
  UNION ALL SELECT c.*, 'old', NOT in_new FROM config_files c WHERE in_old AND NOT broken_old) f"""
SHOWN_NAME = "'Supplier ' || replace(slug, 'supplier_', '')"


@query(
    "brand_config",
    f"""SELECT slug, layout, preferred, {SHOWN_NAME} AS name, 'b-' || n AS brand_id,
      'https://' || slug || '.example' AS base_url, CAST(page_size AS INT) AS page_size,
      CAST(product_limit AS INT) AS product_limit, CAST(n_categories AS INT) AS n_categories FROM ({CONFIG_SQL}) c""",
)
def brand_config(spark, sf_dir):
    loaded = file_sources.brand_configs(v.configs(spark, sf_dir))
    return loaded.select(
        "slug", "layout", "preferred", "name", "brand_id", "base_url", "page_size", "product_limit",
        F.size("categories").alias("n_categories"),
    )


@query("available_brands", f"SELECT {SHOWN_NAME} AS name FROM config_files WHERE in_new OR in_old")
def available_brands(spark, sf_dir):
    return file_sources.available_brands(v.configs(spark, sf_dir))


@query("distinct_brands", "SELECT DISTINCT 'Brand#' || substr(p_brand, 7) AS name FROM part")
def distinct_brands(spark, sf_dir):
    return table(spark, sf_dir, "part").select(title_case(F.upper("p_brand")).alias("name")).distinct()


@query(
    "category_expand",
    f"""SELECT slug, CAST(i - 1 AS INT) AS category_no, lower(n_name) || '_' || i AS category, '00' || i AS category_id
      FROM ({CONFIG_SQL}) c, generate_series(1, 3) g(i) WHERE preferred AND i <= n_categories""",
)
def category_expand(spark, sf_dir):
    loaded = file_sources.brand_configs(v.configs(spark, sf_dir)).filter("preferred")
    return brands.category_expand(loaded, ["slug"])


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an extractor, in another case than the configurations use."""
    key = (F.col("c_custkey") * 3).cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("SUPPLIER "), F.lpad(key, 6, "0")).alias("name")
    )


REGISTERED_SQL = "slug IN (SELECT 'supplier_' || lpad(CAST(c_custkey * 3 AS VARCHAR), 6, '0') FROM customer)"


@query("supported_brands", f"SELECT {SHOWN_NAME} AS name FROM ({CONFIG_SQL}) c WHERE preferred AND {REGISTERED_SQL}")
def supported_brands(spark, sf_dir):
    loaded = file_sources.brand_configs(v.configs(spark, sf_dir)).filter("preferred")
    return brands.supported_brands(loaded.select("name"), registered(spark, sf_dir))


@query(
    "unsupported_brands",
    f"""SELECT {SHOWN_NAME} AS name FROM config_files WHERE (in_new OR in_old)
      AND NOT (coalesce(slug IN (SELECT slug FROM ({CONFIG_SQL}) c WHERE preferred), false) AND {REGISTERED_SQL})""",
)
def unsupported_brands(spark, sf_dir):
    files = v.configs(spark, sf_dir)
    loaded = file_sources.brand_configs(files).filter("preferred").select("name")
    supported = brands.supported_brands(loaded, registered(spark, sf_dir))
    return brands.unsupported_brands(file_sources.available_brands(files), supported)


@query("brand_dim", "SELECT id, name, logo_url FROM dim")
def brand_dim(spark, sf_dir):
    return tables.brand_dim(spark_rows(spark, sf_dir, "SELECT * FROM dim"))


@query(
    "brand_id_lookup",
    """SELECT p_partkey, d.id AS brand_id FROM part LEFT JOIN
      (SELECT lower(name) AS name, arg_max(id, seq) AS id FROM dim GROUP BY lower(name)) d ON lower(p_brand) = d.name""",
)
def brand_id_lookup(spark, sf_dir):
    dim = spark_rows(spark, sf_dir, "SELECT * FROM dim")
    items = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return brands.brand_id_lookup(items, dim, "p_brand", "seq").select("p_partkey", "brand_id")


# ---------------------------------------------------------------- listing table and reports

LISTING_TEXT = "'Brand#7'"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_rows(spark, sf_dir, "SELECT * FROM listing")


SCAN_SQL = """id, brand, sku, name, product_type, category, fabric_slug, fabric_style, fabric_type, color,
  price, original_price, discount_percentage, status, CAST(created_at AS VARCHAR) AS created_at"""


def scanned(rows: DataFrame) -> DataFrame:
    return tables.listing_scan(rows).withColumn("created_at", F.col("created_at").cast("string"))


@query("listing_scan", f"SELECT {SCAN_SQL} FROM listing")
def listing_scan(spark, sf_dir):
    return scanned(listing(spark, sf_dir))


@query(
    "listing_scan_basic",
    """SELECT id, brand, sku, name, product_type, category, price, original_price, status,
      CAST(created_at AS VARCHAR) AS created_at FROM listing""",
)
def listing_scan_basic(spark, sf_dir):
    return scanned(listing(spark, sf_dir).drop("fabric_slug"))


@query("by_brand_eq", f"SELECT id, sku FROM listing WHERE brand = {LISTING_TEXT}")
def by_brand_eq(spark, sf_dir):
    return sets.by_brand(listing(spark, sf_dir), "Brand#7").select("id", "sku")


@query("latest_products", f"SELECT {SCAN_SQL} FROM listing l WHERE brand = {LISTING_TEXT} ORDER BY l.created_at DESC, id LIMIT 10")
def latest_products(spark, sf_dir):
    return scanned(reports.latest_products(listing(spark, sf_dir), "Brand#7"))


@query("sample_products", f"SELECT {SCAN_SQL} FROM listing ORDER BY id LIMIT 10")
def sample_products(spark, sf_dir):
    return scanned(reports.sample_products(listing(spark, sf_dir)))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY brand ORDER BY created_at DESC, id) AS nth FROM listing) l"
REPORT_SQL = """nth || '. [' || brand || '] ' || name || ' (SKU: ' || sku || ')' || chr(10) || '   Type: ' || product_type
  || ' - ' || category || {fabric} || CASE WHEN color <> '' THEN ' | Color: ' || color ELSE '' END || chr(10)
  || '   Price: ' || price || CASE WHEN original_price <> '' THEN ' | Original: ' || original_price ELSE '' END
  || CASE WHEN discount_percentage <> 0 THEN ' (Discount: ' || discount_percentage || '%)' ELSE '' END || chr(10)
  || '   Status: ' || coalesce(status, 'active') || ' | Created: ' || CAST(created_at AS VARCHAR)"""
STYLE_SQL = "CASE WHEN fabric_style <> '' OR fabric_type <> '' THEN ' | ' || fabric_style || ' ' || fabric_type ELSE '' END"
SLUG_SQL = f"CASE WHEN fabric_slug <> '' THEN ' | Fabric: ' || fabric_slug ELSE {STYLE_SQL} END"


@query("report_lines", f"SELECT {REPORT_SQL.format(fabric=SLUG_SQL)} AS line FROM {NUMBERED} WHERE nth <= 10")
def report_lines(spark, sf_dir):
    newest = reports.latest_products_per_brand(listing(spark, sf_dir))
    return newest.select(reports.report_line(with_fabric_slug=True).alias("line"))


@query("report_lines_sample", f"SELECT {REPORT_SQL.format(fabric=STYLE_SQL)} AS line FROM {NUMBERED} WHERE nth <= 10")
def report_lines_sample(spark, sf_dir):
    newest = reports.latest_products_per_brand(listing(spark, sf_dir))
    return newest.select(reports.report_line(with_fabric_slug=False).alias("line"))


@query("report_ordinal", f"SELECT row_number() OVER (ORDER BY {SHOWN_NAME}) AS ordinal, {SHOWN_NAME} AS name FROM config_files WHERE in_new OR in_old")
def report_ordinal(spark, sf_dir):
    return reports.with_ordinal(file_sources.available_brands(v.configs(spark, sf_dir)), "name")


@query("found_count", f"SELECT count(*) AS found FROM {NUMBERED} WHERE nth <= 10")
def found_count(spark, sf_dir):
    return reports.found_count(reports.latest_products_per_brand(listing(spark, sf_dir)))


@query("to_frame", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(NULL AS VARCHAR) AS note FROM events")
def to_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return tables.to_frame(rows, "props", "k INT, note STRING")


@query(
    "merge_datasets",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
      UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier
      UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def merge_datasets(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS segment")
    suppliers = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS name", "s_acctbal AS balance")
    return sets.merge_datasets([customers, suppliers, suppliers])


@query("sorted_header", "SELECT p_brand, p_name, p_partkey, p_retailprice, p_size, p_type FROM part")
def sorted_header(spark, sf_dir):
    return sets.sorted_header(table(spark, sf_dir, "part"))


@query(
    "file_timestamp",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp,
      CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS run_id FROM orders""",
)
def file_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        seasons.file_stamp(F.col("o_orderdate")).alias("stamp"),
        seasons.run_id(F.col("o_orderdate").cast("timestamp")).alias("run_id"),
    )


# ---------------------------------------------------------------- run metadata and items


@query(
    "latest_run_per_brand",
    """SELECT brand, id, seq FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY scraped_at DESC, seq) AS nth
      FROM runs) r WHERE nth = 1""",
)
def latest_run_per_brand(spark, sf_dir):
    runs = spark_rows(spark, sf_dir, "SELECT * FROM runs")
    return run_plans.latest_run_per_brand(runs).select("brand", "id", "seq")


@query("run_brand_lookup", "SELECT id AS scrape_id, arg_min(brand, seq) AS brand FROM runs GROUP BY id")
def run_brand_lookup(spark, sf_dir):
    return run_plans.run_brand(spark_rows(spark, sf_dir, "SELECT * FROM runs"))


@query("run_item_count", "SELECT brand, scrape_id, count(*) AS item_count FROM items GROUP BY brand, scrape_id")
def run_item_count(spark, sf_dir):
    return run_plans.run_item_count(spark_rows(spark, sf_dir, "SELECT * FROM items"))


FIRST_ITEMS = """(SELECT *, row_number() OVER (PARTITION BY brand ORDER BY item_no) AS nth FROM items
  WHERE (brand, scrape_id) IN (SELECT (brand, arg_max(id, scraped_at)) FROM month_runs GROUP BY brand)) i"""
ITEM_SQL = "brand, scrape_id, item_no, sku, category, status"


ITEM_COLUMNS = ["brand", "scrape_id", "item_no", "sku", "category", "status"]


@query("brand_items", f"SELECT {ITEM_SQL}, nth AS ordinal FROM {FIRST_ITEMS} WHERE nth <= 100")
def brand_items(spark, sf_dir):
    store, product = kept_store(spark, sf_dir)
    found = run_plans.brand_items(store.runs(), store.items(), "item_no")
    unwrapped = run_plans.unwrap_items(found, product).drop("ordinal")
    ordinal = found.select("brand", "item_no", F.col("ordinal").cast("bigint").alias("ordinal"))
    return unwrapped.join(ordinal, ["brand", "item_no"]).select(*ITEM_COLUMNS, "ordinal")


@query("by_category", f"SELECT {ITEM_SQL} FROM {FIRST_ITEMS} WHERE nth <= 100 AND category = 'N'")
def by_category(spark, sf_dir):
    store, product = kept_store(spark, sf_dir)
    return store.by_category(product, "N").select(*ITEM_COLUMNS)


@query(
    "by_status",
    f"""SELECT {ITEM_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY nth) AS again
      FROM {FIRST_ITEMS} WHERE nth <= 100 AND status = 'O') s WHERE again <= 20""",
)
def by_status(spark, sf_dir):
    store, product = kept_store(spark, sf_dir)
    return store.by_status(product, "O", limit=20).select(*ITEM_COLUMNS)


STORED_ITEM = "sku STRING, name STRING, category STRING, status STRING, price STRING"


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as the run store keeps them; returned ones lost their stored product.

    The others have their status only there.
    """
    items = spark_rows(spark, sf_dir, "SELECT * FROM items")
    product = F.to_json(F.struct("sku", "name", "category", "status", "price"))
    whole = F.when(F.col("category") == "R", F.lit("null")).otherwise(product)
    return items.select(
        "brand", "scrape_id", "item_no", "sku", "category",
        F.when(F.col("category") == "R", F.col("status")).otherwise("").alias("status"), whole.alias("scraped_data"),
        moment().alias("created_at"),
    )


@query(
    "run_items",
    """SELECT scrape_id, item_no, sku, CASE WHEN category <> 'R' THEN name END AS name, category, status,
      CASE WHEN category <> 'R' THEN price END AS price, CASE WHEN category <> 'R' THEN '' END AS id,
      strftime(TIMESTAMP '2026-01-02 03:04:05', '%Y-%m-%d %H:%M:%S') AS created_at FROM items""",
)
def run_items(spark, sf_dir):
    store, product = kept_store(spark, sf_dir)
    ids = store.runs().select(F.col("id").alias("scrape_id"))
    found = store.run_items(ids, product).drop("brand")
    return found.withColumn("created_at", F.col("created_at").cast("string"))


def filled_store(spark: SparkSession, sf_dir: str, label: str) -> run_plans.RunStore:
    items = stored_items(spark, sf_dir)
    store = run_plans.RunStore(database(spark, label), items.schema)
    store.save_runs(items, moment(), F.monotonically_increasing_id())
    return store


_KEPT: dict[tuple[str, str], run_plans.RunStore] = {}


def kept_store(spark: SparkSession, sf_dir: str) -> tuple[run_plans.RunStore, StructType]:
    """A store that several queries read; its metadata carries the times of the runs."""
    place = (spark.sparkContext.applicationId, sf_dir)
    if place not in _KEPT:
        items = stored_items(spark, sf_dir)
        store = run_plans.RunStore(database(spark, "kept"), items.schema)
        moment_of = F.to_timestamp(F.substring("scrape_id", 1, 6), "yyyyMM")
        store.save_runs(items, moment_of, F.monotonically_increasing_id())
        _KEPT[place] = store
    return _KEPT[place], spark.createDataFrame([], STORED_ITEM).schema


STORE_SQL = """SELECT r.id, r.brand, r.item_count, r.status, i.stored FROM month_runs r
  LEFT JOIN (SELECT scrape_id, count(*) AS stored FROM items GROUP BY scrape_id) i ON r.id = i.scrape_id"""


def store_contents(store: run_plans.RunStore) -> DataFrame:
    stored = store.items().groupBy(F.col("scrape_id").alias("id")).agg(F.count("*").alias("stored"))
    return store.runs().join(stored, "id", "left").select("id", "brand", "item_count", "status", "stored")


@query("save_run", STORE_SQL)
def save_run(spark, sf_dir):
    return store_contents(filled_store(spark, sf_dir, "runs"))


@query(
    "delete_run",
    f"SELECT s.*, true AS deleted, false AS again FROM ({STORE_SQL}) s WHERE id <> (SELECT max(id) FROM month_runs)",
)
def delete_run(spark, sf_dir):
    store = filled_store(spark, sf_dir, "runs")
    newest = store.runs().agg(F.max("id")).first()[0]
    deleted, again = store.delete_run(newest), store.delete_run(newest)
    return store_contents(store).withColumns({"deleted": F.lit(deleted), "again": F.lit(again)})


@query("runs_scan", "SELECT id, brand, item_count, status, seq FROM runs")
def runs_scan(spark, sf_dir):
    db = database(spark, "metadata")
    db.create_if_absent("runs", RUNS)
    db.append("runs", spark_rows(spark, sf_dir, "SELECT * FROM runs"))
    stored = tables.table_or_empty(spark, db.qualified("runs"), RUNS)
    absent = tables.table_or_empty(spark, f"{db.name}.never_written", RUNS)
    return stored.unionByName(absent).select("id", "brand", "item_count", "status", "seq")


# ---------------------------------------------------------------- sinks and stored tables


@query(
    "listing_pages",
    "SELECT DISTINCT brand, page_category AS category, CAST(start AS INT) AS start, ok, true AS has_body FROM va",
)
def listing_pages(spark, sf_dir):
    path = scratch_path(spark, "captured")
    v.pages_a(spark, sf_dir).write.parquet(path)
    pages = file_sources.listing_pages(spark, path)
    return pages.select("brand", "category", "start", "ok", (F.length("html") > 0).alias("has_body"))


DUMP_ROW = "p_partkey BIGINT, p_name STRING, p_size INT, missing STRING"


@query("read_dump", "SELECT p_partkey, p_name, p_size, CAST(NULL AS VARCHAR) AS missing FROM part WHERE floor(p_partkey / 500) % 3 <> 1")
def read_dump(spark, sf_dir):
    """Array files of up to 500 products each, some broken off, read back with a missing path."""
    path = scratch_path(spark, "dump")
    dump = F.floor(F.col("p_partkey") / 500).alias("dump")
    rows = table(spark, sf_dir, "part").groupBy(dump).agg(
        F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("value")
    )
    broken = F.when(F.col("dump") % 3 == 1, F.expr("left(value, length(value) - 9)")).otherwise(F.col("value"))
    rows = rows.withColumn("value", broken)
    rows.repartition("dump").write.partitionBy("dump").text(path)
    schema = spark.createDataFrame([], DUMP_ROW).schema
    found = file_sources.read_dump(spark, f"{path}/dump=*", schema)
    return found.unionByName(file_sources.read_dump(spark, f"{path}/absent", schema))


@query("write_json", "SELECT id, brand, sku, name, price FROM listing")
def write_json(spark, sf_dir):
    rows = listing(spark, sf_dir).select("id", "brand", "sku", "name", "price")
    path = file_sinks.write_json(rows, scratch_path(spark, "json"), "All Brands", datetime(2026, 1, 2))
    return file_sources.read_rows(spark, path, rows.schema)


@query(
    "write_csv",
    """SELECT '["' || p_type || '"]' AS colors, CAST(k AS VARCHAR) AS id, name, NULL AS price FROM va
      UNION ALL SELECT NULL, CAST(k AS VARCHAR), name, price_x FROM vb""",
)
def write_csv(spark, sf_dir):
    first = spark_rows(spark, sf_dir, "SELECT k AS id, name, p_type FROM va")
    first = first.select("id", "name", F.array("p_type").alias("colors"))
    second = spark_rows(spark, sf_dir, "SELECT k AS id, name, price_x AS price FROM vb")
    rows = sets.merge_datasets([first, second])
    path = file_sinks.write_csv(rows, scratch_path(spark, "csv"), "All Brands", datetime(2026, 1, 2))
    schema = "colors STRING, id STRING, name STRING, price STRING"
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


LISTING_STORED = "sku, name, category, price, on_sale, in_stock"


@query(
    "append_listing",
    f"""SELECT sku_x AS sku, name, category_x AS category, price_x AS price,
      coalesce({DISCOUNT_A} > 0, false) AS on_sale, in_stock_x AS in_stock FROM va WHERE usable_x
      UNION ALL SELECT sku_x, name, coalesce(name_category_x, listed_category_x), '', false, true FROM vb WHERE usable_x""",
)
def append_listing(spark, sf_dir):
    db = database(spark, "listing")
    catalog.append_listing(db, projections.listing_row(products_a(spark, sf_dir)))
    catalog.append_listing(db, projections.listing_row(products_b(spark, sf_dir)))
    return db.read("product_listing").select("sku", "name", "category", "price", "on_sale", "in_stock")


@query(
    "create_product_table",
    """SELECT sku_x AS sku, name, type_x AS type, category_x AS category, CAST(NULL AS BOOLEAN) AS has_detaild_info,
      true AS created_first, false AS created_again FROM va WHERE usable_x""",
)
def create_product_table(spark, sf_dir):
    db = database(spark, "products")
    first, again = catalog.create_product_table(db), catalog.create_product_table(db)
    db.append("product", projections.product_row(products_a(spark, sf_dir), "b"))
    return db.read("product").select(
        "sku", "name", "type", "category", "has_detaild_info",
        F.lit(first).alias("created_first"), F.lit(again).alias("created_again"),
    )


@query(
    "upsert_products",
    """SELECT 'S' || p_partkey AS sku, coalesce(n.name, p_name) AS name, coalesce(n.category, p_type) AS category,
      n.name IS NOT NULL AS replaced, true AS dense_id, false AS created_later
      FROM part LEFT JOIN (SELECT sku, arg_max(name, item_no) AS name, arg_max(category, item_no) AS category
        FROM items WHERE status <> 'F' GROUP BY sku) n ON n.sku = 'S' || p_partkey
      UNION ALL SELECT NULL, name, category, true, true, true FROM items WHERE status = 'F'""",
)
def upsert_products(spark, sf_dir):
    """Parts as the stored catalogue, then every line item as an update; many share a sku and
    those with status F carry none."""
    db = database(spark, "upsert")
    catalog.create_product_table(db)
    old = table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), F.col("p_partkey")).alias("sku"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
    )
    catalog.upsert_products(
        db, projections.product_row(old).withColumn("seq", F.lit(1)), "seq", moment("2020-01-01 00:00:00")
    )
    items = spark_rows(spark, sf_dir, "SELECT * FROM items")
    update = items.select(
        F.when(F.col("status") != "F", F.col("sku")).alias("sku"), "name", "category", "item_no",
        F.array(F.lit("new")).alias("material"),
    )
    catalog.upsert_products(db, projections.product_row(update, None, "item_no"), "item_no", moment())
    return db.read("product").select(
        "sku", "name", "category", F.col("material").isNotNull().alias("replaced"),
        F.col("id").between(1, F.lit(db.read("product").agg(F.count_distinct("id")).first()[0])).alias("dense_id"),
        (F.col("created_at") >= moment()).alias("created_later"),
    )


OLD_LISTING = ["id", "brand", "sku", "name", "image_url"]


@query(
    "evolve_listing",
    """SELECT id, sku, image_url, CAST(NULL AS VARCHAR) AS fabric_slug, CAST(NULL AS VARCHAR) AS primary_image_url,
      CAST(NULL AS DOUBLE) AS discount_percentage, CAST(7 AS INT) AS added, CAST(0 AS INT) AS added_again FROM listing""",
)
def evolve_listing(spark, sf_dir):
    db = database(spark, "evolve")
    catalog.append_listing(db, listing(spark, sf_dir).select(*OLD_LISTING))
    added, again = catalog.evolve_listing(db), catalog.evolve_listing(db)
    assert added == LISTING_ADDITIONS.fieldNames()
    return db.read("product_listing").select(
        "id", "sku", "image_url", "fabric_slug", "primary_image_url", "discount_percentage",
        F.lit(len(added)).alias("added"), F.lit(len(again)).alias("added_again"),
    )


@query("backfill_image", "SELECT id, coalesce(primary_image_url, image_url) AS primary_image_url FROM listing")
def backfill_image(spark, sf_dir):
    return catalog.backfill_image(listing(spark, sf_dir)).select("id", "primary_image_url")


@query(
    "harvest_enriched",
    f"SELECT url_x AS url, {ENRICHED_SQL} FROM (SELECT d.*, enriched_x AND sku_x <> '' AND suffix <> '' AS hit FROM vdy d "
    "JOIN (SELECT k AS kept_k FROM kept_b) kk ON d.k = kept_k) e",
)
def harvest_enriched(spark, sf_dir):
    """Dialect B end to end: pages to products, then joined to their detail documents."""
    listed = plans.harvest(v.captured_b(spark, sf_dir), shops(spark, sf_dir, "b"), DIALECT_B)
    products = listed.select(*PRODUCT_B.fieldNames())
    return piped_all(enrich.enrich_products(products, detail_rows(spark, sf_dir)))
