"""Read-back reports over the listing table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcat.operators.dedup import top_per_key
from loomcat.session import materialize

REPORT_LIMIT = 10  # fixed value: rows in a read-back report


def _shown(name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def _some(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def latest_products(listing: DataFrame, brand: str, limit: int = REPORT_LIMIT) -> DataFrame:
    """Newest rows of a brand. Plans as a pushed filter and a per-task top-k."""
    return listing.filter(F.col("brand") == brand).orderBy(F.desc("created_at"), "id").limit(limit)


def latest_products_per_brand(listing: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """The same report for every brand at once, numbered within its brand."""
    return top_per_key(listing, ["brand"], limit, F.desc("created_at"), F.asc("id"))


def sample_products(listing: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """Some rows; by id, so that the choice is repeatable."""
    return listing.orderBy("id").limit(limit)


def report_line(with_fabric_slug: bool) -> Column:
    """Text of one report row; expects ``ordinal`` and the report columns."""
    style = F.concat(
        F.lit(" | "), _shown("fabric_style", ""), F.lit(" "), _shown("fabric_type", "")
    )
    fabric = F.when(_some("fabric_style") | _some("fabric_type"), style)
    if with_fabric_slug:
        slug = F.concat(F.lit(" | Fabric: "), F.col("fabric_slug"))
        fabric = F.when(_some("fabric_slug"), slug).otherwise(fabric)
    color = F.when(_some("color"), F.concat(F.lit(" | Color: "), F.col("color")))
    discount = F.when(
        F.coalesce(F.col("discount_percentage") != 0, F.lit(False)),
        F.concat(F.lit(" (Discount: "), F.col("discount_percentage").cast("string"), F.lit("%)")),
    )
    original = F.when(
        _some("original_price"), F.concat(F.lit(" | Original: "), F.col("original_price"))
    )
    nothing = F.lit("")
    return F.concat(
        F.col("ordinal").cast("string"), F.lit(". ["), _shown("brand", "None"), F.lit("] "),
        _shown("name", "None"), F.lit(" (SKU: "), _shown("sku", "None"), F.lit(")\n"),
        F.lit("   Type: "), _shown("product_type", "N/A"), F.lit(" - "),
        _shown("category", "N/A"), F.coalesce(fabric, nothing), F.coalesce(color, nothing),
        F.lit("\n   Price: "), _shown("price", "N/A"), F.coalesce(original, nothing),
        F.coalesce(discount, nothing),
        F.lit("\n   Status: "), _shown("status", "active"), F.lit(" | Created: "),
        _shown("created_at", "None"),
    )


def with_ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """Number all rows from 1 in the given order without gathering them in one task.

    The rows are range-sorted and written once with their partition and place in it; the number
    is the place plus the rows of earlier partitions. Only one count per partition is windowed.
    """
    sorted_rows = rows.orderBy(*order).withColumns(
        {"_part": F.spark_partition_id(), "_mark": F.monotonically_increasing_id()}
    )
    placed = materialize(
        sorted_rows.withColumn("_place", F.col("_mark").bitwiseAND((1 << 33) - 1)).drop("_mark"),
        "ordinal",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.join(offsets, "_part")
        .withColumn("ordinal", F.col("_place") + F.col("_offset") + 1)
        .drop("_part", "_place", "_offset")
    )


def found_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("found"))
