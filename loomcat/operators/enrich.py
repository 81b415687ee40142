"""Products joined to their detail records, and the requests that would fetch missing ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.functions.details import FABRIC_ATTRIBUTES, words_array
from loomcat.functions.prices import percent_off
from loomcat.functions.titles import category_from_name, unify_category
from loomcat.functions.urls import product_code, size_from_sku
from loomcat.operators.dedup import last_per_key

# Size code by the piece count a product type contains.
PIECE_SIZES = {"3 Piece": "3PC", "2 Piece": "2PC"}


def _first_color() -> Column:
    return F.coalesce(F.get("colors", F.lit(0)), F.lit(""))


def _requestable() -> Column:
    return F.coalesce((F.col("sku") != "") & (_first_color() != ""), F.lit(False))


def detail_requests(products: DataFrame) -> DataFrame:
    """Products worth a detail capture: id, first colour and the size the product type tells."""
    size = F.lit(None).cast("string")
    for piece, code in reversed(PIECE_SIZES.items()):
        size = F.when(F.col("product_type").contains(piece), F.lit(code)).otherwise(size)
    return products.filter(_requestable()).select(
        F.col("sku").alias("id"), _first_color().alias("color"), size.alias("size")
    )


def request_manifest(requests: DataFrame) -> DataFrame:
    """What to capture per request: a map of variation parameters. Rows only, nothing is sent."""
    color = F.upper("color")
    prefix = F.concat(F.lit("dwvar_"), product_code(F.col("id")), F.lit("__"), color)
    size = F.coalesce("size", size_from_sku(F.col("id")))
    parameters = F.create_map(
        F.concat(prefix, F.lit("_color")), color,
        F.concat(prefix, F.lit("_size")), size,
        F.lit("pid"), F.col("id"),
        F.lit("quantity"), F.lit("1"),
        F.lit("fromSizeSwatch"), F.lit("true"),
    )
    return requests.select("id", parameters.alias("parameters"))


def enrich_products(
    products: DataFrame, details: DataFrame, sequence: str = "seq", within: tuple[str, ...] = ()
) -> DataFrame:
    """Left join to the last detail record per sku; a usable record overwrites the row.

    ``within`` names columns of both sides that must be equal too, such as the brand.

    Overwriting is by match, not by value: a record without a name empties the name. Products
    that cannot match get spread-out keys of their own, so that rows without a sku do not all
    land in one join partition. Repeated skus of matching rows are left to AQE's skew join.
    """
    latest = last_per_key(details, ["sku", *within], sequence).filter("usable")
    apart = ("sku", "usable", sequence, "raw_data", *within)
    record = latest.select(
        F.col("sku").alias("_join_key"),
        *within,
        F.struct(*(c for c in latest.columns if c not in apart)).alias("_d"),
    )
    no_match = F.concat(F.lit("\u0000"), F.xxhash64("url", "name").cast("string"))
    keyed = products.withColumn("_join_key", F.when(_requestable(), F.col("sku")).otherwise(no_match))
    joined = keyed.join(record, ["_join_key", *within], "left").drop("_join_key")

    d = F.col("_d")
    matched = d.isNotNull()
    current = d["price_current"]
    original = F.when(d["price_original"] == 0, current).otherwise(d["price_original"])
    new_category = F.coalesce(category_from_name(d["name"]), F.col("category"))
    taken = {
        "name": d["name"],
        "short_description": d["short_description"],
        "long_description": d["long_description"],
        "rating": d["rating"],
        "is_new": d["is_new"],
        "is_sale": (current < original) & (current > 0),
        **{name: words_array(d["fabric_details"][name]) for name in FABRIC_ATTRIBUTES},
        "colors": d["colors"],
        "sizes": d["sizes"],
        "collection": d["collection"],
        "launch_time": d["launch_time"],
        "product_concept": d["product_concept"],
        "price_current": current,
        "price_original": original,
        "discount_percentage": percent_off(current, original),
        "in_stock": d["in_stock"],
        "remaining_stock": d["remaining_stock"],
        "has_detailed_info": F.lit(True),
        "img_url": d["images"],
        "category": unify_category(new_category),
    }
    columns = [c for c in products.columns if c not in taken]
    return joined.select(
        *columns,
        *(
            F.when(matched, value).otherwise(F.col(name)).alias(name)
            if name in products.columns
            else F.when(matched, value).alias(name)
            for name, value in taken.items()
        ),
    )


def enriched_count(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count_if(F.coalesce("has_detailed_info", F.lit(False))).alias("enriched"),
        F.count("*").alias("total"),
    )


def launch_order(products: DataFrame, *ties: str) -> DataFrame:
    """Chronological by launch time, which sorts as text."""
    return products.orderBy("launch_time", *ties)
