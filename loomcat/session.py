"""Session settings, the shared work folder, and cutting lineage by writing a table."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "loomcat", cores: int | None = None, **conf: str) -> SparkSession:
    """Session for local work and tests; on a cluster pass ``cores=None`` and submit normally.

    Only ``cores`` sets a master and a fixed shuffle width. On a cluster AQE coalesces whatever
    ``spark.sql.shuffle.partitions`` the operator of the cluster chose.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in _SETTINGS.items():
        builder = builder.config(key, value)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.shuffle.partitions", str(cores))
            .config("spark.driver.memory", os.environ.get("LOOMCAT_DRIVER_MEMORY", "8g"))
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: the one the cluster names in ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    local = tempfile.mkdtemp(prefix="loomcat-")
    context.setCheckpointDir(local)
    return context.getCheckpointDir().rstrip("/")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions that were not submitted with it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves this file to its executors for as long as the application runs.
    archive = os.path.join(tempfile.mkdtemp(prefix="loomcat-package-"), "loomcat")
    context.addPyFile(shutil.make_archive(archive, "zip", parent, "loomcat"))
    _shipped.add(context.applicationId)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Change a session setting for one write; an insert into a table ignores it as an option."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, grouped by application so it can be expired."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/loomcat/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Used where a costly stage has two consumers. Unlike caching it survives lost executors
    without recomputation, and later readers prune columns from Parquet.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
