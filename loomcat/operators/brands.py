"""Brand dimension lookups, the brand registry joins and category expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.operators.dedup import last_per_key


def brand_id_lookup(items: DataFrame, brand_dim: DataFrame, brand: str, sequence: str) -> DataFrame:
    """Add ``brand_id`` by brand name regardless of case; the last of equal names wins.

    The dimension's size is not assumed: AQE broadcasts it only if the measured side is small.
    """
    ids = last_per_key(
        brand_dim.select(
            F.lower("name").alias("_brand_key"), F.col("id").alias("brand_id"), F.col(sequence)
        ),
        ["_brand_key"],
        sequence,
    ).drop(sequence)
    return (
        items.withColumn("_brand_key", F.lower(brand))
        .join(ids, "_brand_key", "left")
        .drop("_brand_key")
    )


def supported_brands(brands: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Brands that have an extractor, ignoring case."""
    known = registry.select(F.lower(name).alias("_brand_key"))
    keyed = brands.withColumn("_brand_key", F.lower(name))
    return keyed.join(known, "_brand_key", "left_semi").drop("_brand_key")


def unsupported_brands(brands: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """Brands without an extractor."""
    known = registry.select(F.lower(name).alias("_brand_key"))
    keyed = brands.withColumn("_brand_key", F.lower(name))
    return keyed.join(known, "_brand_key", "left_anti").drop("_brand_key")


def category_expand(configs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per configured category, with its place in the configuration."""
    entries = F.posexplode(F.map_entries("categories")).alias("category_no", "_entry")
    return configs.select(*columns, entries).select(
        *columns,
        "category_no",
        F.col("_entry.key").alias("category"),
        F.col("_entry.value").alias("category_id"),
    )


def tag_brand(items: DataFrame, brand_id: str | None) -> DataFrame:
    """Put brand_id first and drop brand; an item's own id stays. Nothing changes without an id."""
    if brand_id is None:
        return items
    given = F.lit(brand_id)
    own = F.coalesce(F.col("brand_id"), given) if "brand_id" in items.columns else given
    rest = [c for c in items.columns if c not in ("brand", "brand_id")]
    return items.select(own.alias("brand_id"), *rest)


def tag_from_dimension(items: DataFrame, brand_dim: DataFrame, sequence: str) -> DataFrame:
    """Items of all brands, each tagged with its brand's id if the dimension has one.

    Where it has, ``brand`` is empty and an item's own id stays; other items stay as they are.
    """
    named = items.withColumnRenamed("brand_id", "_own")
    found = brand_id_lookup(named, brand_dim, "brand", sequence)
    rest = [c for c in items.columns if c not in ("brand", "brand_id")]
    own = F.coalesce("_own", "brand_id").alias("brand_id")
    return found.select(own, F.when(F.col("brand_id").isNull(), F.col("brand")).alias("brand"), *rest)


SMALL_ROWS, SMALL_BYTES = 100_000, 64 << 20


def small(table: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """The table, marked for broadcast only if its rows and their text are counted to be few."""
    text = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    counted = table.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(text), F.lit(0)).alias("b")).first()
    return F.broadcast(table) if counted["n"] <= rows and counted["b"] <= size else table
