"""Reads of stored tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.schemas import LISTING_BASIC_COLUMNS, LISTING_REPORT_COLUMNS


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows if it does not exist."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def brand_dim(source: DataFrame) -> DataFrame:
    """id, name and logo address of the brand table."""
    return source.select("id", "name", "logo_url")


def brand_dim_table(spark: SparkSession, name: str) -> DataFrame:
    try:
        return brand_dim(spark.table(name))
    except AnalysisException:
        return spark.createDataFrame([], "id STRING, name STRING, logo_url STRING")


def listing_scan(listing: DataFrame) -> DataFrame:
    """All report columns, or only the basic ones when any of them is missing."""
    complete = set(LISTING_REPORT_COLUMNS) <= set(listing.columns)
    return listing.select(*(LISTING_REPORT_COLUMNS if complete else LISTING_BASIC_COLUMNS))


def to_frame(rows: DataFrame, value: str, schema: str) -> DataFrame:
    """Loosely keyed JSON rows to typed columns; a missing key is NULL."""
    keep = [c for c in rows.columns if c != value]
    parsed = rows.select(*keep, F.from_json(value, schema).alias("_row"))
    return parsed.select(*keep, "_row.*")
