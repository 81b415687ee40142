"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcat.session import materialize

SPACE = r"[\x20\x09-\x0D]"  # fixed value: what separates words
#: Rows a broadcast table may have; the callers' rows are under 200 bytes, so 20 MB at most.
BROADCAST_ROWS = 100_000
#: Bytes of texts that go to a Python worker at once; Spark's own bound is 64 MB, held several times over.
BATCH_BYTES = "8m"
#: Bits of a row of ``perhaps``'s table, as Spark's bitmaps have them, and rows it may have: 8 MB at most.
BITMAP_BITS, BITMAP_ROWS = 32_768, 2_048
#: Bits an id gets there while the table is not full: one in sixteen of the other rows passes.
BITS_PER_ID = 16
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def if_small(table: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, written once, marked for broadcast only if it has at most ``rows`` rows."""
    table = materialize(table, label)
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def perhaps(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``ids`` (a written table of one column), and a few others.

    A broadcast bitmap of hashed ids decides, so nothing is shuffled. It has a bounded size: with
    very many ids more of the other rows pass, but never fewer of the wanted ones.
    """
    n_rows = min(BITMAP_ROWS, max(1, -(-BITS_PER_ID * ids.count() // BITMAP_BITS)))

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(n_rows * BITMAP_BITS))

    placed = ids.select(place(ids.columns[0]).alias("_place"))
    bitmap = placed.groupBy(F.expr("_place DIV 32768").alias("_row")).agg(
        F.bitmap_construct_agg(F.col("_place") % BITMAP_BITS).alias("_bits")
    )
    placed = rows.withColumn("_place", place(key)).withColumn("_row", F.expr("_place DIV 32768"))
    byte = F.expr("CAST(conv(hex(substring(_bits, CAST(_place % 32768 DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    hit = F.getbit(byte, F.expr("CAST(_place % 8 AS INT)")) == 1
    return placed.join(F.broadcast(bitmap), "_row").filter(hit).select(*rows.columns)


def among(rows: DataFrame, key: str, ids: DataFrame, label: str) -> DataFrame:
    """The rows whose ``key`` is among ``ids``; most others are dropped before anything is shuffled."""
    ids = materialize(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), label)
    return perhaps(rows, key, ids).join(ids, F.col(key) == F.col("_id"), "left_semi")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, in a session that left their size at Spark's default."""
    if spark.conf.get(_BATCH_SETTING) == "67108864b":
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
