"""Connected components of a link table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) of every node with a link; links are a, b.

    Each step hangs a node's neighbours under the smallest of them; both kinds of step in turn leave
    stars after a number of rounds that grows with the logarithm of the longest path. Steps are joins
    and minima on single keys; the links are written between rounds.
    """
    a, b = F.col("a"), F.col("b")
    links = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before = materialize(links, "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(a.alias("node"), b.alias("root"))
        before = state
        links = materialize(_small_star(_large_star(links)), "links")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.filter("b > a").join(least, "a")
    return larger.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.withColumnRenamed("m", "b")).distinct()
