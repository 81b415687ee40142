"""Which listing pages and products count: stop rules, quotas and limits.

One category may hold a third of all pages, so nothing here gathers a category in one task. The
stop rule is a partial aggregate joined back; missing pages and running product counts are found
in bounded runs of thin page rows and then between runs. A brand, a category and a start name one
page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_RUN = 1024


def page_prefix(
    pages: DataFrame, page_size: Column | int, keys: list[str], start: str = "start"
) -> DataFrame:
    """Keep each category's pages up to its first terminal one or its first missing one.

    ``pages`` has ok, no_results and n_products (extracted products, not tiles). A failed,
    no-results or empty page gives nothing and ends its category; a short page counts and ends it.
    The pages of a category begin at 0 and follow each other by the page size; pages at other
    places are never asked for, and nothing beyond a page that was not captured is.
    """
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    gives = F.col("ok") & ~F.col("no_results") & (F.col("n_products") > 0)
    full = F.coalesce(gives & (F.col("n_products") >= size), F.lit(False))
    pages = pages.filter(F.try_mod(F.col(start), size) == 0)
    last = pages.filter(~full).select(*keys, F.col(start).alias("_last"))
    gaps = first_gaps(pages, size, keys, start).select(*keys, (F.col("_gap") - 1).alias("_last"))
    stops = last.unionAll(gaps).groupBy(*keys).agg(F.min("_last").alias("_last"))
    return (
        pages.filter(F.coalesce(gives, F.lit(False)))
        .join(stops, keys, "left")
        .filter(F.col("_last").isNull() | (F.col(start) <= F.col("_last")))
        .drop("_last")
    )


def first_gaps(pages: DataFrame, size: Column, keys: list[str], start: str = "start") -> DataFrame:
    """Start ``_gap`` of each category's first page whose predecessor is missing, if there is one.

    Pages look back within runs of ``PAGES_PER_RUN`` places; the first page of a run is compared
    with the last one of the run before, by a join of one row per run.
    """
    run = F.floor(F.col(start) / (size * PAGES_PER_RUN)).alias("_run")
    thin = pages.select(*keys, start, size.alias("_size"), run)
    before = F.lag(start).over(Window.partitionBy(*keys, "_run").orderBy(start))
    runs = (
        thin.withColumn("_inner", F.when(before < F.col(start) - F.col("_size"), F.col(start)))
        .groupBy(*keys, "_run")
        .agg(
            F.min("_inner").alias("_inner"),
            F.min(start).alias("_first"),
            F.max(start).alias("_end"),
            F.max("_size").alias("_size"),
        )
    )
    ends = runs.select(*keys, (F.col("_run") + 1).alias("_run"), F.col("_end").alias("_before"))
    joined = F.col("_before").isNotNull() & (F.col("_before") >= F.col("_first") - F.col("_size"))
    edge = F.when((F.col("_first") > 0) & ~joined, F.col("_first"))
    return (
        runs.join(ends, [*keys, "_run"], "left")
        .select(*keys, F.coalesce(F.least(edge, "_inner"), edge, "_inner").alias("_gap"))
        .groupBy(*keys)
        .agg(F.min("_gap").alias("_gap"))
        .filter("_gap IS NOT NULL")
    )


def page_offsets(
    pages: DataFrame, page_size: Column | int, keys: list[str], start: str = "start"
) -> DataFrame:
    """Key, start and products of each page with ``first_rank``: products on its category's earlier pages."""
    size = F.lit(page_size) if isinstance(page_size, int) else page_size
    run = F.floor(F.col(start) / (size * PAGES_PER_RUN)).alias("_run")
    thin = pages.select(*keys, start, "n_products", run)
    in_run = Window.partitionBy(*keys, "_run").orderBy(start)
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        thin.groupBy(*keys, "_run")
        .agg(F.sum("n_products").alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    within = F.coalesce(
        F.sum("n_products").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        thin.withColumn("_within", within)
        .join(runs, [*keys, "_run"])
        .select(*keys, start, "n_products", (F.col("_before") + F.col("_within")).alias("first_rank"))
    )


def category_quota(limit: Column | int, categories: Column | int) -> Column:
    """Products allowed per category: the limit shared out, whole for one category, 0 = no limit."""
    total = F.lit(limit) if isinstance(limit, int) else limit
    count = F.lit(categories) if isinstance(categories, int) else categories
    shared = F.floor(total / F.greatest(count, F.lit(1))).cast("int")
    return F.when(total <= 0, F.lit(0)).otherwise(F.when(count <= 1, total).otherwise(shared))


def apply_quota(
    pages: DataFrame,
    products: str,
    page_size: Column | int,
    quota: Column | int,
    keys: list[str],
    start: str = "start",
) -> DataFrame:
    """Cut each category to its quota of products in page and tile order; 0 = no quota.

    ``products`` is an array column of extracted products in tile order; pages wholly past the
    quota are dropped and the page that crosses it is sliced, all before anything is exploded.
    """
    allowed = F.lit(quota) if isinstance(quota, int) else quota
    takes = page_takes(pages, page_size, allowed, F.lit(0), keys, keys, keys, start)
    return apply_takes(pages, takes, products, keys, start)


def page_takes(
    pages: DataFrame,
    page_size: Column | int,
    quota: Column,
    limit: Column,
    keys: list[str],
    group: list[str],
    order: list[str],
    start: str = "start",
) -> DataFrame:
    """Key and start of the pages that count, with the number ``take`` of their products that do.

    Each category gives up to its quota, then each group of categories up to its limit; 0 = neither.
    The place of a page's first product in its group is the sum of what the categories before it
    give, from one row per category, and of the products on the category's earlier pages, from
    ``page_offsets``. So only pages are counted; no product is numbered or even read.
    """
    thin = pages.select(
        *keys, start, "n_products", *(c for c in order if c not in keys),
        quota.alias("_quota"), limit.alias("_limit"),
        (F.lit(page_size) if isinstance(page_size, int) else page_size).alias("_size"),
    )
    given = F.when(F.col("_quota") > 0, F.least(F.col("_all"), F.col("_quota"))).otherwise(F.col("_all"))
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    places = (
        thin.groupBy(*keys, *(c for c in order if c not in keys))
        .agg(F.sum("n_products").alias("_all"), F.max("_quota").alias("_quota"), F.max("_limit").alias("_limit"))
        .withColumn("_before", F.coalesce(F.sum(given).over(earlier), F.lit(0)))
        .select(*keys, "_before", "_quota", "_limit")
    )
    rank = F.col("first_rank")
    left = F.least(
        F.col("n_products").cast("long"),
        F.when(F.col("_quota") > 0, F.col("_quota") - rank),
        F.when(F.col("_limit") > 0, F.col("_limit") - F.col("_before") - rank),
    )
    offsets = page_offsets(thin, F.col("_size"), keys, start)
    return (
        offsets.join(places, keys)
        .select(*keys, start, left.cast("int").alias("take"))
        .filter("take > 0")
    )


def apply_takes(pages: DataFrame, takes: DataFrame, products: str, keys: list[str], start: str = "start") -> DataFrame:
    """The pages that count, cut to the number of products that do."""
    cut = F.when(F.col("take") < F.size(products), F.slice(products, 1, F.col("take"))).otherwise(F.col(products))
    return pages.join(takes, [*keys, start]).withColumn(products, cut).drop("take")


def category_counts(products: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Products per category with the running total in category order."""
    brand_keys = [key for key in keys if key not in order]
    running = Window.partitionBy(*brand_keys).orderBy(*order)
    return (
        products.groupBy(*keys)
        .agg(F.count("*").alias("n_products"))
        .withColumn("running_total", F.sum("n_products").over(running))
    )
