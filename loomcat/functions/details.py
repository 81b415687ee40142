"""Detail documents: one JSON body per product to typed attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.functions.prices import percent_off, stock_flag
from loomcat.functions.seasons import collection_label, launch_month, launch_time
from loomcat.functions.text import to_double, to_int, words
from loomcat.functions.titles import category_from_name, unify_category
from loomcat.functions.urls import normalize_image_url

# Attribute names of a detail document and the preferred image groups.
DOCUMENT_SCHEMA = """
product STRUCT<
  images: MAP<STRING, ARRAY<STRUCT<url: STRING>>>,
  variationAttributes: ARRAY<STRUCT<id: STRING, values: ARRAY<STRUCT<displayValue: STRING>>>>,
  custom: STRUCT<top_fabric_attribute: STRING, bottom_fabric_attribute: STRING,
    dupatta_fabric_attribute: STRING, main_fabric_attribute: STRING, material: STRING,
    technique: STRING, launch: STRING, productConcept: STRING, season_attribute: STRING>,
  price: STRUCT<sales: MAP<STRING, STRING>, list: MAP<STRING, STRING>>,
  available: STRING, availableStatus: STRING, maxOrderQuantity: STRING, isNew: STRING,
  productName: STRING, productType: STRING, shortDescription: STRING, longDescription: STRING,
  rating: STRING, gtmData: STRUCT<category: STRING>>,
_broken STRING
"""
IMAGE_GROUPS = ["large", "hi-res", "small"]
FABRIC_ATTRIBUTES = {
    "top_fabric": "top_fabric_attribute",
    "bottom_fabric": "bottom_fabric_attribute",
    "dupatta_fabric": "dupatta_fabric_attribute",
    "main_fabric": "main_fabric_attribute",
    "material": "material",
    "technique": "technique",
}
VARIATIONS = ["color", "size"]
REQUIRED_OBJECTS = ["product", "images", "variationAttributes", "custom", "gtmData"]


def _or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words_array(text: Column) -> Column:
    """Words with every | removed first, so A|B joins; an empty text gives NULL."""
    return F.when(text != "", words(F.replace(text, F.lit("|"), F.lit(""))))


def size_value(size: Column) -> Column:
    """All-digit sizes lose their leading zeros, others stay."""
    return F.when(
        size.rlike("^[0-9]+$"), F.regexp_replace(size, "^0+(?=[0-9])", "")
    ).otherwise(size)


def variation_values(attributes: Column, attribute: str) -> Column:
    """Shown values of the last attribute with this id; an empty array when there is none."""
    matching = F.filter(attributes, lambda a: a["id"] == attribute)
    values = F.try_element_at(matching, F.lit(-1))["values"]
    shown = F.transform(values, lambda v: _or_empty(v["displayValue"]))
    return F.coalesce(shown, F.array().cast("array<string>"))


def image_order(images: Column, base_url: Column) -> Column:
    """Addresses of large, hi-res and small images, then other groups in document order."""
    none = F.array().cast("array<struct<url:string>>")
    preferred = [F.coalesce(images[group], none) for group in IMAGE_GROUPS]
    others = F.filter(F.map_entries(images), lambda e: ~e["key"].isin(IMAGE_GROUPS))
    rest = F.coalesce(F.flatten(F.transform(others, lambda e: F.coalesce(e["value"], none))), none)
    listed = F.filter(F.concat(*preferred, rest), lambda i: i["url"] != "")
    urls = F.transform(listed, lambda i: normalize_image_url(i["url"], base_url))
    return image_dedup(F.coalesce(urls, F.array().cast("array<string>")))


def image_dedup(urls: Column) -> Column:
    """Keep the first address of each file name."""
    names = F.transform(urls, lambda u: F.substring_index(u, "/", -1))
    return F.filter(
        urls, lambda u, i: F.array_position(names, F.substring_index(u, "/", -1)) == i + 1
    )


def fabric_details(custom: Column) -> Column:
    return F.struct(
        *(_or_empty(custom[source]).alias(name) for name, source in FABRIC_ATTRIBUTES.items())
    )


def detail_category(name: Column, tag_category: Column) -> Column:
    return unify_category(F.coalesce(category_from_name(name), _or_empty(tag_category)))


def _price(values: Column) -> Column:
    return F.coalesce(to_double(values["value"]), F.lit(0.0))


def _unreadable(values: Column) -> Column:
    """A price that is given but is null or no number."""
    given = F.coalesce(F.map_contains_key(values, "value"), F.lit(False))
    return given & to_double(values["value"]).isNull()


def _null_object(body: Column) -> Column:
    """An object the record needs is spelled out as null. Parsed only where the text hints at it."""
    hint = body.rlike('"(' + "|".join(REQUIRED_OBJECTS) + r')"\s*:\s*null')
    document = F.try_parse_json(body)
    found = F.lit(False)
    for name in REQUIRED_OBJECTS:
        path = "$.product" if name == "product" else f"$.product.{name}"
        found = found | F.is_variant_null(F.try_variant_get(document, path, "variant"))
    return F.when(hint, F.coalesce(found, F.lit(False))).otherwise(F.lit(False))


def _null_inside(body: Column) -> Column:
    """A null where the record reads a list or an entry of one: image groups, colours and sizes.

    ``from_json`` gives the same for a null and for an absent list, so the document is read as a
    variant where its text holds a null at all.
    """
    document = F.try_parse_json(body)

    def null(value: Column) -> Column:
        return F.coalesce(value.isNull() | F.is_variant_null(value), F.lit(False))

    def entries(value: Column) -> Column:
        return F.try_variant_get(value, "$", "array<variant>")

    def any_null(values: Column) -> Column:
        return F.coalesce(F.exists(values, null), F.lit(False))

    groups = F.map_values(F.try_variant_get(document, "$.product.images", "map<string,variant>"))
    images = any_null(groups) | F.coalesce(F.exists(groups, lambda g: any_null(entries(g))), F.lit(False))
    attributes = F.try_variant_get(document, "$.product.variationAttributes", "array<variant>")

    def bad_values(attribute: Column) -> Column:
        read = F.try_variant_get(attribute, "$.id", "string").isin(VARIATIONS)
        values = F.try_variant_get(attribute, "$.values", "variant")
        given_null = F.coalesce(F.is_variant_null(values), F.lit(False))
        return F.coalesce(read, F.lit(False)) & (given_null | any_null(entries(values)))

    variations = any_null(attributes) | F.coalesce(F.exists(attributes, bad_values), F.lit(False))
    return F.when(body.contains("null"), images | variations).otherwise(F.lit(False))


def parse_document(body: Column) -> Column:
    """Body to a struct; ``_broken`` holds text that is no JSON."""
    return F.from_json(
        body, DOCUMENT_SCHEMA, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}
    )


def detail_records(captures: DataFrame, base_url: str | Column, as_of: Column) -> DataFrame:
    """Captured (sku, ..., body) rows to detail records; columns other than body are kept.

    ``usable`` is false where the capture gives no attributes: no body, broken JSON, a null
    object, a null among or instead of the entries of a list that is read, or a price that is not a
    number.
    """
    base = F.lit(base_url) if isinstance(base_url, str) else base_url
    keys = [c for c in captures.columns if c != "body"]
    # As a generated row the document is parsed once, whatever is filtered or read later.
    doc = captures.select(*keys, "body", F.inline(F.array(parse_document(F.col("body")))))
    p = F.col("product")
    price = p["price"]
    object_body = F.ltrim("body").startswith("{")
    usable = (
        object_body
        & F.col("_broken").isNull()
        & ~_unreadable(price["sales"])
        & ~_unreadable(price["list"])
        & ~_null_object(F.col("body"))
        & ~_null_inside(F.col("body"))
    )
    staged = doc.select(
        *keys,
        "body",
        F.coalesce(usable, F.lit(False)).alias("usable"),
        p.alias("_p"),
        _or_empty(p["productName"]).alias("_name"),
        _price(price["sales"]).alias("_current"),
        _price(price["list"]).alias("_list"),
        launch_month(p["custom"]["launch"]).alias("_month"),
    )
    p, current = F.col("_p"), F.col("_current")
    original = F.when(F.col("_list") == 0, current).otherwise(F.col("_list"))
    is_new = F.coalesce(p["isNew"].try_cast("boolean"), F.lit(False))
    rating = F.coalesce(to_double(p["rating"]), F.lit(0.0))
    short, long = _or_empty(p["shortDescription"]), _or_empty(p["longDescription"])
    kind = _or_empty(p["productType"])
    return staged.select(
        *keys,
        "usable",
        F.col("_name").alias("name"),
        kind.alias("product_type"),
        detail_category(F.col("_name"), p["gtmData"]["category"]).alias("category"),
        words_array(short).alias("short_description"),
        long.alias("long_description"),
        rating.alias("rating"),
        is_new.alias("is_new"),
        (current < original).alias("is_sale"),
        current.alias("price_current"),
        original.alias("price_original"),
        percent_off(current, original).alias("discount_percentage"),
        image_order(p["images"], base).alias("images"),
        variation_values(p["variationAttributes"], "color").alias("colors"),
        F.transform(variation_values(p["variationAttributes"], "size"), size_value).alias("sizes"),
        stock_flag(
            F.coalesce(p["available"].try_cast("boolean"), F.lit(False)), p["availableStatus"]
        ).alias("in_stock"),
        F.coalesce(to_int(p["maxOrderQuantity"]), F.lit(0)).alias("remaining_stock"),
        fabric_details(p["custom"]).alias("fabric_details"),
        collection_label(p["custom"]["season_attribute"], F.col("_month"), as_of).alias(
            "collection"
        ),
        launch_time(F.col("_month"), as_of).alias("launch_time"),
        _or_empty(p["custom"]["productConcept"]).alias("product_concept"),
        F.struct(
            is_new.alias("is_new"),
            (current < original).alias("is_sale"),
            F.col("_name").alias("product_name"),
            kind.alias("product_type"),
            short.alias("short_description"),
            long.alias("long_description"),
            rating.alias("rating"),
        ).alias("metadata"),
        F.col("body").alias("raw_data"),
    )
