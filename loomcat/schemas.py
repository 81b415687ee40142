"""Fixed table schemas. An absent value is a typed NULL."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Schema of ``name KIND, ...``; unlike ``fromDDL`` it needs no running session."""
    pairs = (column.split(" ") for column in columns.split(", "))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# Column names and types of the stored tables.
PRODUCT_A = _schema(
    "brand STRING, brand_id STRING, sku STRING, name STRING, slug STRING, fabric_style STRING, "
    "fabric_type STRING, product_type STRING, category STRING, collection STRING, "
    "piece_info STRING, url STRING, img_url ARRAY<STRING>, price STRING, original_price STRING, "
    "discount_percentage INT, on_sale BOOLEAN, in_stock BOOLEAN"
)
PRODUCT_B = _schema(
    "brand STRING, brand_id STRING, sku STRING, name STRING, slug STRING, product_type STRING, "
    "category STRING, colors ARRAY<STRING>, url STRING"
)
PRODUCT_B_ENRICHED = _schema(
    "brand STRING, brand_id STRING, sku STRING, name STRING, slug STRING, product_type STRING, "
    "category STRING, colors ARRAY<STRING>, url STRING, short_description ARRAY<STRING>, "
    "long_description STRING, rating DOUBLE, is_new BOOLEAN, is_sale BOOLEAN, "
    "top_fabric ARRAY<STRING>, bottom_fabric ARRAY<STRING>, dupatta_fabric ARRAY<STRING>, "
    "main_fabric ARRAY<STRING>, material ARRAY<STRING>, technique ARRAY<STRING>, "
    "sizes ARRAY<STRING>, collection STRING, launch_time STRING, product_concept STRING, "
    "price_current DOUBLE, price_original DOUBLE, discount_percentage DOUBLE, in_stock BOOLEAN, "
    "remaining_stock INT, has_detailed_info BOOLEAN, img_url ARRAY<STRING>"
)
# One misspelt column name is part of the table's contract.
PRODUCT_TABLE = _schema(
    "id BIGINT, sku STRING, name STRING, brand_id STRING, url STRING, slug STRING, type STRING, "
    "category STRING, colors ARRAY<STRING>, sizes ARRAY<STRING>, "
    "short_description ARRAY<STRING>, long_description STRING, collection STRING, rating DOUBLE, "
    "is_new BOOLEAN, is_sale BOOLEAN, material ARRAY<STRING>, technique ARRAY<STRING>, "
    "img_url ARRAY<STRING>, has_detaild_info BOOLEAN, created_at TIMESTAMP"
)
LISTING_ROW = _schema(
    "brand_id STRING, sku STRING, name STRING, product_type STRING, category STRING, "
    "collection STRING, piece_info STRING, fabric_slug STRING, fabric_style STRING, "
    "fabric_type STRING, color STRING, url STRING, primary_image_url STRING, "
    "hover_image_url STRING, image_url STRING, price STRING, original_price STRING, "
    "discount_percentage DOUBLE, on_sale BOOLEAN, in_stock BOOLEAN, raw_data STRING"
)
# Columns an older listing table may lack, in the order they are added.
LISTING_ADDITIONS = _schema(
    "fabric_slug STRING, fabric_style STRING, fabric_type STRING, color STRING, "
    "primary_image_url STRING, hover_image_url STRING, discount_percentage DOUBLE"
)
LISTING_REPORT_COLUMNS = [
    "id", "brand", "sku", "name", "product_type", "category", "fabric_slug", "fabric_style",
    "fabric_type", "color", "price", "original_price", "discount_percentage", "status",
    "created_at",
]
LISTING_BASIC_COLUMNS = [
    "id", "brand", "sku", "name", "product_type", "category", "price", "original_price", "status",
    "created_at",
]
RUNS = _schema(
    "id STRING, brand STRING, item_count BIGINT, scraped_at TIMESTAMP, status STRING, seq BIGINT"
)
RUN_ITEM_TEXT_COLUMNS = [
    "sku", "name", "product_type", "fabric_style", "fabric_type", "category", "color", "url",
    "primary_image_url", "hover_image_url", "price", "original_price", "discount_percentage",
    "status",
]
BRAND_CONFIG = _schema(
    "name STRING, brand_id STRING, base_url STRING, search_api_url STRING, "
    "headers MAP<STRING,STRING>, timeout INT, categories MAP<STRING,STRING>, page_size INT, "
    "product_limit INT, max_workers INT, sleep_between_requests INT, retry_count INT, "
    "retry_delay INT, enhance_with_details BOOLEAN, detail_workers INT, product_selector STRING, "
    "name_selector STRING, product_brand_selector STRING, subtitle_selector STRING, "
    "price_selector STRING, original_price_selector STRING, discount_selector STRING, "
    "pdp_link_selector STRING, primary_image_selector STRING, hover_image_selector STRING, "
    "product_variation_api STRING"
)
