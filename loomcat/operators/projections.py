"""Row shapes of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.schemas import LISTING_ROW, PRODUCT_TABLE, RUN_ITEM_TEXT_COLUMNS

# Product table columns that have another name in a product.
PRODUCT_TABLE_SOURCES = {"type": "product_type", "has_detaild_info": "has_detailed_info"}


def raw_payload() -> Column:
    """The whole row as JSON; absent values are left out."""
    return F.to_json(F.struct("*"))


def _column_or(df: DataFrame, name: str, kind, default=None) -> Column:
    empty = F.lit(default).cast(kind)
    return F.coalesce(F.col(name).cast(kind), empty) if name in df.columns else empty


def _text(df: DataFrame, name: str) -> Column:
    return _column_or(df, name, "string", "")


def listing_row(products: DataFrame, brand_id: str | None = None) -> DataFrame:
    """Rows of the listing table; absent texts are empty, on_sale is false and in_stock true."""
    special = {
        "brand_id": _column_or(products, "brand_id", "string", brand_id),
        "image_url": _text(products, "primary_image_url"),
        "discount_percentage": _column_or(products, "discount_percentage", "double"),
        "on_sale": _column_or(products, "on_sale", "boolean", False),
        "in_stock": _column_or(products, "in_stock", "boolean", True),
        "raw_data": raw_payload(),
    }
    return products.select(
        *(special.get(n, _text(products, n)).alias(n) for n in LISTING_ROW.fieldNames())
    )


def product_row(products: DataFrame, brand_id: str | None = None, *carried: str) -> DataFrame:
    """Rows of the product table without its generated columns; the brand id is the given one.

    ``carried`` names columns passed along, such as the sequence an upsert orders by.
    """
    columns = [F.col(name) for name in carried]
    for field in PRODUCT_TABLE:
        if field.name in ("id", "created_at"):
            continue
        source = PRODUCT_TABLE_SOURCES.get(field.name, field.name)
        given = F.lit(brand_id).cast("string") if field.name == "brand_id" else None
        value = given if given is not None else _column_or(products, source, field.dataType)
        columns.append(value.alias(field.name))
    return products.select(*columns)


def run_item_row(
    products: DataFrame, run_id: Column, brand: Column, created_at: Column
) -> DataFrame:
    """Rows of the run store: all texts, the whole product as JSON, and when it was stored."""
    return products.select(
        run_id.alias("scrape_id"),
        brand.alias("brand"),
        *(_text(products, name).alias(name) for name in RUN_ITEM_TEXT_COLUMNS),
        raw_payload().alias("scraped_data"),
        created_at.alias("created_at"),
    )
