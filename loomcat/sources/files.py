"""File sources. Every reader gives a DataFrame; nothing is read on the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.functions.text import title_case
from loomcat.schemas import BRAND_CONFIG

PAGE_SCHEMA = "brand STRING, category STRING, start INT, ok BOOLEAN, html STRING"
CAPTURE_SCHEMA = "sku STRING, seq BIGINT, body STRING"

# The two places a brand configuration may have, newer one first.
NEW_LAYOUT = r"(?:^|/)brands/([^/]+)/config/config\.json$"
OLD_LAYOUT = r"(?:^|/)config/([^/]+)_config\.json$"


def read_dump(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Products of JSON dump files, each one array; none for a missing path or an unreadable file.

    A file that is no JSON gives nothing and leaves the other files alone. Dumps written by Spark
    (one object per line) are read with ``read_rows`` instead, which splits large files.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
        readable = whole.filter(F.try_parse_json("value").isNotNull())
        return readable.select(F.inline(F.from_json("value", T.ArrayType(schema))))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON-lines files."""
    return spark.read.schema(schema).json(path)


def listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured listing pages."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def listing_page_files(spark: SparkSession, root: str) -> DataFrame:
    """Captured pages kept as HTML files under brand=.../category=.../start=... folders."""
    return (
        spark.read.schema("value STRING, brand STRING, category STRING, start INT")
        .text(root, wholetext=True)
        .select("brand", "category", "start", F.lit(True).alias("ok"), F.col("value").alias("html"))
    )


def detail_docs(spark: SparkSession, path: str) -> DataFrame:
    """Captured detail documents; an unsuccessful capture has no body."""
    return spark.read.schema(CAPTURE_SCHEMA).parquet(path)


def config_files(spark: SparkSession, root: str) -> DataFrame:
    """Configuration files of both layouts as (path, body)."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*config.json")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )


def _layouts(path: Column) -> tuple[Column, Column]:
    return F.regexp_extract(path, NEW_LAYOUT, 1), F.regexp_extract(path, OLD_LAYOUT, 1)


def brand_configs(files: DataFrame) -> DataFrame:
    """Configurations of both layouts, concatenated; unreadable files are left out.

    ``preferred`` marks the row a single brand's load gets: the new layout's file where there is
    one, readable or not, else the old layout's.
    """
    new, old = _layouts(F.col("path"))
    schema = T.StructType([*BRAND_CONFIG, T.StructField("_broken", T.StringType())])
    parsed = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_broken"})
    keyed = files.withColumns(
        {"slug": F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit(""))), "_new": new != ""}
    ).filter(F.col("slug").isNotNull())
    has_new = keyed.filter("_new").select("slug").distinct().withColumn("_has_new", F.lit(True))
    readable = keyed.withColumn("_config", parsed).filter(
        F.col("_config").isNotNull() & F.col("_config._broken").isNull()
    )
    return readable.join(has_new, "slug", "left").select(
        "slug",
        F.when(F.col("_new"), "new").otherwise("old").alias("layout"),
        (F.col("_new") | F.col("_has_new").isNull()).alias("preferred"),
        *(F.col(f"_config.{name}").alias(name) for name in BRAND_CONFIG.fieldNames()),
    )


def available_brands(files: DataFrame) -> DataFrame:
    """Brand names the configuration paths tell, each once; the files are not opened."""
    new, old = _layouts(F.col("path"))
    slug = F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))
    return (
        files.select(title_case(F.replace(slug, F.lit("_"), F.lit(" "))).alias("name"))
        .filter(F.col("name").isNotNull())
        .distinct()
    )
