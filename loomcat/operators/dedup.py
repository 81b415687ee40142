"""One row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order.

    ``row_number = 1`` plans as a window group limit, which keeps one row per key and task before
    the shuffle, so a key with very many copies does not gather in one task.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(ranked)).filter("_nth = 1").drop("_nth")


def last_per_key(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Last row per key by an explicit sequence column."""
    return first_per_key(df, keys, F.col(sequence).desc())


# Fixed value: the largest rank Spark turns into a per-task limit before the shuffle by default.
GROUP_LIMIT = 1000
SHARES = 64


def top_per_key(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows per key with their ordinal; a report's limit, not a safety cap.

    Small limits are applied by each task before the shuffle. Larger ones are not by Spark itself,
    so each key is cut in shares first; what is left of a key is bounded by shares times limit.
    """
    nth = F.row_number()
    if limit > GROUP_LIMIT:
        share = Window.partitionBy(*keys, "_share").orderBy(*order)
        df = (
            df.withColumn("_share", F.spark_partition_id() % SHARES)
            .withColumn("_nth", nth.over(share))
            .filter(F.col("_nth") <= limit)
            .drop("_share", "_nth")
        )
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("ordinal", nth.over(ranked)).filter(F.col("ordinal") <= limit)
