"""The run store: metadata rows and items partitioned by brand and run."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.operators.dedup import first_per_key, top_per_key
from loomcat.schemas import RUNS
from loomcat.sinks.catalog import CatalogDatabase

DEFAULT_LIMIT = 100  # fixed value: items a read gives unless told otherwise
ITEM_PARTITIONS = ("brand", "scrape_id")


def run_item_count(items: DataFrame) -> DataFrame:
    return items.groupBy("brand", "scrape_id").agg(F.count("*").alias("item_count"))


def latest_run_per_brand(runs: DataFrame) -> DataFrame:
    """Newest run of each brand; of equal times the one stored first."""
    return first_per_key(runs, ["brand"], F.desc_nulls_last("scraped_at"), F.asc("seq"))


def run_brand(runs: DataFrame) -> DataFrame:
    """Brand of each run id: that of its first metadata row."""
    return first_per_key(runs, ["id"], F.asc("seq")).select(F.col("id").alias("scrape_id"), "brand")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of all brands; of equal times the one stored first."""
    return runs.orderBy(F.desc_nulls_last("scraped_at"), "seq").limit(1)


def items_of_runs(ids: DataFrame, runs: DataFrame, items: DataFrame) -> DataFrame:
    """Items of the given run ids, found under the brand their metadata names.

    Where items are partitioned by brand and run, only the partitions that the metadata names are
    read: the join prunes them while the query runs.
    """
    wanted = ids.select("scrape_id").distinct().join(run_brand(runs), "scrape_id")
    return items.join(wanted, ["brand", "scrape_id"], "left_semi")


def unwrap_items(items: DataFrame, product: T.StructType) -> DataFrame:
    """The stored product of each item with an empty id and the item's time.

    An item whose stored data is no object keeps its own columns.
    """
    is_object = F.coalesce(F.ltrim("scraped_data").startswith("{"), F.lit(False))
    staged = items.withColumns(
        {"_object": is_object, "_product": F.from_json("scraped_data", product)}
    )
    columns = []
    for field in product:
        own = F.col(field.name).cast(field.dataType) if field.name in items.columns else None
        inner = F.when(F.col("_object"), F.col(f"_product.{field.name}"))
        if own is not None:
            inner = inner.otherwise(own)
        columns.append(inner.alias(field.name))
    own_keys = [c for c in (*ITEM_PARTITIONS, "item_no") if c in items.columns and c not in product.names]
    shown = F.when(F.col("_object"), F.lit("")).alias("id")
    return staged.select(*own_keys, *columns, shown, "created_at")


def stored_text(items: DataFrame, name: str) -> Column:
    """A text of the stored product, or of the item's own column where no object is stored.

    What the product holds under this name counts only if it is a text, as an equality would have it.
    """
    if "scraped_data" not in items.columns:
        return F.col(name)
    whole = F.try_parse_json("scraped_data")
    value = F.try_variant_get(whole, f"$.{name}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(whole, f"$.{name}", "string"))
    own = F.col(name) if name in items.columns else F.lit(None).cast("string")
    is_object = F.coalesce(F.ltrim("scraped_data").startswith("{"), F.lit(False)) & whole.isNotNull()
    return F.when(is_object, text).otherwise(own)


def brand_items(
    runs: DataFrame, items: DataFrame, position: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """First items of each brand's latest run."""
    latest = latest_run_per_brand(runs).select("brand", F.col("id").alias("scrape_id"))
    newest = items.join(latest, ["brand", "scrape_id"], "left_semi")
    return top_per_key(newest, ["brand"], limit, F.asc(position))


def _filtered(items: DataFrame, condition: Column, limit: int) -> DataFrame:
    kept = items.drop("ordinal").filter(condition)
    return top_per_key(kept, ["brand"], limit, F.asc("_position"))


def by_category(
    runs: DataFrame, items: DataFrame, category: str, position: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Category rows among each brand's first items: the filter stays above the first limit."""
    first = brand_items(runs, items, position).withColumn("_position", F.col("ordinal"))
    return _filtered(first, stored_text(first, "category") == category, limit).drop("_position")


def by_status(
    runs: DataFrame, items: DataFrame, status: str, position: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    first = brand_items(runs, items, position).withColumn("_position", F.col("ordinal"))
    return _filtered(first, stored_text(first, "status") == status, limit).drop("_position")


class RunStore:
    """Run metadata and items as catalog tables."""

    def __init__(self, db: CatalogDatabase, items: T.StructType):
        self.db = db
        db.create_if_absent("runs", RUNS)
        db.create_if_absent("run_items", items, *ITEM_PARTITIONS)

    def runs(self) -> DataFrame:
        return self.db.read("runs")

    def items(self) -> DataFrame:
        return self.db.read("run_items")

    def save_runs(self, items: DataFrame, moment: Column, seq: Column) -> None:
        """Store items of one or more runs and one metadata row per run.

        The items are computed and written once, to a folder of their own below the table; the
        counts are those of the written rows, so both agree whatever the plan behind them does. The
        rebalance hint gives each run few files and splits a run that is very large. The table's
        partitions are then pointed to the folder. A run saved again, also by a retried job, takes
        the place of its earlier items.
        """
        spark, table = self.db.spark, self.db.qualified("run_items")
        schema = self.items().schema
        path = f"{self.db.location('run_items')}/saved-{uuid.uuid4().hex}"
        rows = items.select(*schema.names).hint("rebalance", *(F.col(c) for c in ITEM_PARTITIONS))
        rows.write.option("compression", "zstd").partitionBy(*ITEM_PARTITIONS).parquet(path)
        written = spark.read.schema(schema).parquet(path)
        self._point(table, written.select(*ITEM_PARTITIONS, F.col("_metadata.file_path").alias("file")))
        self.db.append(
            "runs",
            run_item_count(written).select(
                F.col("scrape_id").alias("id"),
                "brand",
                "item_count",
                moment.alias("scraped_at"),
                F.lit("completed").alias("status"),
                seq.alias("seq"),
            ),
        )

    def _point(self, table: str, files: DataFrame) -> None:
        """Make the folders of written files the table's partitions of their runs, one row per run."""
        # A file's path is given as a URI, a partition's location as plain text. Only a sort finds the
        # least of texts by run, so the files are listed; there are few for each run.
        found = {(r[0], r[1]): unquote(r["file"].rsplit("/", 1)[0]) for r in files.distinct().collect()}
        runs = list(found.items())
        for begin in range(0, len(runs), 100):
            part = runs[begin : begin + 100]
            specs = [", ".join(f"{c} = {_literal(x)}" for c, x in zip(ITEM_PARTITIONS, run, strict=True)) for run, _ in part]
            places = [_literal(place) for _, place in part]
            gone = ", ".join(f"PARTITION ({spec})" for spec in specs)
            self.db.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {gone}")
            new = " ".join(f"PARTITION ({s}) LOCATION {x}" for s, x in zip(specs, places, strict=True))
            self.db.spark.sql(f"ALTER TABLE {table} ADD {new}")

    def latest(self, brand: str | None = None) -> DataFrame:
        """Newest run of a brand, or of all brands."""
        runs = self.runs()
        return latest_run(runs if brand is None else runs.filter(F.col("brand") == brand))

    def run_items(self, ids: DataFrame, product: T.StructType) -> DataFrame:
        """Stored products of the given runs (``scrape_id``)."""
        return unwrap_items(items_of_runs(ids, self.runs(), self.items()), product)

    def brand_items(
        self, product: T.StructType, brand: str | None = None, position: str = "item_no", limit: int = DEFAULT_LIMIT
    ) -> DataFrame:
        """Stored products that stand first in the newest run of a brand, or of each brand."""
        return unwrap_items(brand_items(self._runs_of(brand), self.items(), position, limit), product)

    def by_category(
        self, product: T.StructType, category: str, brand: str | None = None, position: str = "item_no",
        limit: int = DEFAULT_LIMIT,
    ) -> DataFrame:
        """Products of a category among the first ones of a brand, or of each brand."""
        found = by_category(self._runs_of(brand), self.items(), category, position, limit)
        return unwrap_items(found, product)

    def by_status(
        self, product: T.StructType, status: str, brand: str | None = None, position: str = "item_no",
        limit: int = DEFAULT_LIMIT,
    ) -> DataFrame:
        return unwrap_items(by_status(self._runs_of(brand), self.items(), status, position, limit), product)

    def _runs_of(self, brand: str | None) -> DataFrame:
        return self.runs() if brand is None else self.runs().filter(F.col("brand") == brand)

    def delete_run(self, run_id: str) -> bool:
        """Remove a run's first metadata row and its items; true if there were items."""
        runs = self.runs()
        found = runs.filter(F.col("id") == run_id).orderBy("seq").limit(1).collect()
        if not found:
            return False
        first = found[0]
        same = (
            (F.col("id") == run_id)
            & F.col("brand").eqNullSafe(first["brand"])
            & F.col("seq").eqNullSafe(first["seq"])
        )
        self.db.replace("runs", runs.filter(~F.coalesce(same, F.lit(False))))
        if not first["brand"]:
            return False
        table = self.db.qualified("run_items")
        spec = ", ".join(
            f"{column} = {_literal(value)}"
            for column, value in zip(ITEM_PARTITIONS, (first["brand"], run_id), strict=True)
        )
        stored = self.db.spark.sql(f"SHOW PARTITIONS {table} PARTITION ({spec})")
        if stored.isEmpty():
            return False
        self.db.spark.sql(f"ALTER TABLE {table} DROP PARTITION ({spec})")
        return True


def _literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
