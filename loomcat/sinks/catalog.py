"""The product and listing tables in a Spark catalog database.

Parquet tables have no row updates, so a change writes a new version of the table and readers
take the newest. A version is listed only after its data is complete, which makes the switch
atomic; older versions stay readable until ``drop_old_versions``. The product table, where a change
touches few rows of many, is cut into buckets by sku instead, and an upsert replaces the buckets that
it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.operators.dedup import last_per_key
from loomcat.schemas import LISTING_ADDITIONS, PRODUCT_TABLE
from loomcat.session import materialize, setting

BUCKET = "_bucket"
BUCKETS = 64  # fixed for the life of a table


class CatalogDatabase:
    """Versioned tables of one database."""

    def __init__(self, spark: SparkSession, name: str, location: str | None = None):
        self.spark = spark
        self.name = name
        place = f" LOCATION '{location}'" if location else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}{place}")

    def versions(self, table: str) -> list[int]:
        listed = self.spark.catalog.listTables(self.name, f"{table}__v*")
        return sorted(int(t.name.rsplit("__v", 1)[1]) for t in listed if not t.isTemporary)

    def qualified(self, table: str) -> str:
        """Name of the newest version."""
        return f"{self.name}.{table}__v{self.versions(table)[-1]}"

    def location(self, table: str) -> str:
        """Folder of the newest version."""
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.qualified(table)}")
        return described.filter("col_name = 'Location'").first()["data_type"]

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.qualified(table)).drop(BUCKET)

    def create_if_absent(self, table: str, schema: T.StructType, *partitions: str) -> bool:
        """Create an empty first version unless there is one; tells whether it did."""
        if self.exists(table):
            return False
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name}.{table}__v1 ({columns}) USING parquet{by}"
        )
        return True

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows to the newest version, by column name."""
        target = self.read(table)
        missing = [f for f in target.schema if f.name not in rows.columns]
        complete = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        complete = complete.select(*target.columns)
        if BUCKET in self.spark.table(self.qualified(table)).columns:
            complete = complete.withColumn(BUCKET, sku_bucket())
        complete.write.insertInto(self.qualified(table))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write the next version; ``rows`` may read the current one."""
        following = (self.versions(table) or [0])[-1] + 1
        rows.write.format("parquet").saveAsTable(f"{self.name}.{table}__v{following}")

    def drop_old_versions(self, table: str) -> None:
        for version in self.versions(table)[:-1]:
            self.spark.sql(f"DROP TABLE {self.name}.{table}__v{version}")


def sku_bucket(buckets: int = BUCKETS) -> Column:
    """Bucket of a product row; rows without a sku are dealt by what they hold."""
    spread = F.xxhash64("name", "url", "slug", "long_description")
    return F.pmod(F.when(F.col("sku").isNull(), spread).otherwise(F.xxhash64("sku")), F.lit(buckets)).cast("int")


def create_product_table(db: CatalogDatabase) -> bool:
    return db.create_if_absent("product", T.StructType([*PRODUCT_TABLE, T.StructField(BUCKET, T.IntegerType())]), BUCKET)


def upsert_rows(
    target: DataFrame, incoming: DataFrame, sequence: str, created_at: Column
) -> DataFrame:
    """Product table after replacing by sku: the last incoming row of a sku wins.

    A replaced row keeps its id and creation time. Rows without a sku never conflict: each gets a
    key of its own, which keeps all of them and spreads them over the join's partitions. Both
    inputs are read once.
    """
    payload = [c for c in target.columns if c not in ("id", "created_at", BUCKET)]

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        own = F.concat(F.lit(f"\u0000{side}"), F.monotonically_increasing_id().cast("string"))
        return rows.withColumn("_key", F.coalesce("sku", own))

    fresh = last_per_key(keyed(incoming, "new"), ["_key"], sequence)
    new = fresh.select("_key", F.struct(*payload).alias("_new"))
    old = keyed(target, "old").select("_key", F.struct("id", "created_at", *payload).alias("_old"))
    replaced, absent = F.col("_new").isNotNull(), F.col("_old").isNull()
    values = {
        "id": F.col("_old.id"),
        "created_at": F.when(absent, created_at).otherwise(F.col("_old.created_at")),
        **{c: F.when(replaced, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) for c in payload},
    }
    return old.join(new, "_key", "full").select(*(v.alias(c) for c, v in values.items()))


def upsert_products(
    db: CatalogDatabase, incoming: DataFrame, sequence: str, created_at: Column
) -> None:
    """Upsert product rows by sku; new rows get the numbers that follow the highest id.

    Only the buckets that incoming rows with a sku fall into are read and written again, each as a
    whole. Rows without a sku never conflict; in other buckets they are added as further files.
    Everything is worked out before the table is touched, so that a repeated task reads what the
    first one did.
    """
    name = db.qualified("product")
    stored = db.spark.table(name)
    payload = [c for c in stored.columns if c not in ("id", "created_at", BUCKET)]
    rows = materialize(incoming.select(*payload, F.col(sequence).alias("_seq")), "upsert-rows")
    keyed, loose = rows.filter("sku IS NOT NULL"), rows.filter("sku IS NULL")
    fresh = last_per_key(keyed, ["sku"], "_seq").withColumn(BUCKET, sku_bucket())
    touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
    old = stored.filter(F.col(BUCKET).isin(touched)) if touched else stored.filter(F.lit(False))
    merged = upsert_rows(old, fresh, "_seq", created_at).withColumn(BUCKET, sku_bucket())
    merged = materialize(merged, "upserted")
    highest = stored.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = loose.select(*payload).withColumns({"created_at": created_at, BUCKET: sku_bucket()})
    numbered = _numbered(merged.filter("id IS NULL").drop("id").unionByName(added), highest)
    inside = F.col(BUCKET).isin(touched) if touched else F.lit(False)
    replaced = merged.filter("id IS NOT NULL").unionByName(numbered.filter(inside))
    columns, bucket = stored.columns, F.col(BUCKET)
    with setting(db.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
        replaced.select(*columns).hint("rebalance", bucket).write.insertInto(name, overwrite=True)
    if len(touched) < BUCKETS:  # rows without a sku may fall into other buckets, too
        numbered.filter(~inside).select(*columns).hint("rebalance", bucket).write.insertInto(name)


def _numbered(rows: DataFrame, highest: int) -> DataFrame:
    """The rows with ids ``highest + 1`` and on, without gaps.

    Rows are written once with their task and their place in it; the numbers of rows in the tasks,
    one row each, tell where a task's ids begin.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(rows.withColumns({"_task": F.spark_partition_id(), "_place": place}), "numbered")
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    tasks = tasks.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    number = (F.lit(highest + 1) + F.col("_begin") + F.col("_place")).alias("id")
    return placed.join(tasks, "_task").select("*", number).drop("_task", "_place", "_begin")


def append_listing(db: CatalogDatabase, rows: DataFrame) -> None:
    db.create_if_absent("product_listing", rows.schema)
    db.append("product_listing", rows)


def evolve_listing(db: CatalogDatabase) -> list[str]:
    """Add the columns an older listing table lacks; gives their names, none the second time."""
    present = set(db.read("product_listing").columns)
    lacking = [f for f in LISTING_ADDITIONS if f.name not in present]
    if lacking:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lacking)
        db.spark.sql(f"ALTER TABLE {db.qualified('product_listing')} ADD COLUMNS ({columns})")
    return [f.name for f in lacking]


def backfill_image(listing: DataFrame) -> DataFrame:
    """Primary image from the older image column where it is null."""
    return listing.withColumn("primary_image_url", F.coalesce("primary_image_url", "image_url"))
