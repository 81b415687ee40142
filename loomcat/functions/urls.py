"""URLs, product identifiers found in them, and image addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcat.functions.text import title_case

# Piece words in collection slugs, in priority order, and size codes in product codes.
PIECE_SLUGS = {
    "one-piece": "One Piece",
    "two-piece": "Two Piece",
    "three-piece": "Three Piece",
}
SIZE_CODES = ["1PC", "2PC", "3PC"]
DEFAULT_SIZE = "3PC"


def absolute_url(url: Column, base_url: Column) -> Column:
    """Put the base in front of a non-empty address that does not start with http."""
    literal_base = F.regexp_replace(base_url, r"([\\$])", r"\\$1")
    return F.regexp_replace(url, r"^(?!http|\z)", literal_base)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def normalize_image_url(url: Column, base_url: Column) -> Column:
    return absolute_url(strip_query(url), base_url)


def segment_after(url: Column, marker: str) -> Column:
    """Path segment after the first segment equal to ``marker``; empty when there is none."""
    return F.regexp_extract(url, f"(?:^|/){marker}/([^/]*)", 1)


def piece_info(collection: Column) -> Column:
    result = F.lit("")
    for piece, label in reversed(PIECE_SLUGS.items()):
        result = F.when(collection.contains(piece), F.lit(label)).otherwise(result)
    return result


def category_from_collection(collection: Column) -> Column:
    """Readable category of a collection slug, without its piece prefix."""
    bare = collection
    for piece in reversed(PIECE_SLUGS):
        bare = F.when(
            collection.contains(piece), F.replace(collection, F.lit(f"{piece}-"), F.lit(""))
        ).otherwise(bare)
    return title_case(F.replace(bare, F.lit("-"), F.lit(" ")))


def sku_from_product_path(url: Column) -> Column:
    """Segment after ``products`` up to its first dot, else empty."""
    return F.substring_index(segment_after(url, "products"), ".", 1)


def sku_from_file_name(url: Column) -> Column:
    """Last path segment up to its first dot, if the path has segments and it holds an underscore."""
    return F.regexp_extract(url, r"/([^/._]*_[^/.]*)(?:\.[^/]*)?\z", 1)


def lazy_image(data_src: Column, src: Column) -> Column:
    """Deferred address of an image, else its plain one, without the query; empty when neither."""
    picked = F.coalesce(F.nullif(data_src, F.lit("")), src, F.lit(""))
    return strip_query(picked)


def image_pair(primary: Column, hover: Column) -> Column:
    """Array of the non-empty addresses."""
    return F.array_compact(F.array(F.nullif(primary, F.lit("")), F.nullif(hover, F.lit(""))))


def product_code(sku: Column) -> Column:
    return F.substring_index(sku, "_", 1)


def size_from_sku(sku: Column) -> Column:
    """Size code in the last or second-to-last hyphen part of the product code, else the default."""
    parts = F.split(product_code(sku), "-")
    count = F.size(parts)
    last, before = F.get(parts, count - 1), F.get(parts, count - 2)
    return (
        F.when((count > 1) & last.isin(SIZE_CODES), last)
        .when((count > 1) & before.isin(SIZE_CODES), before)
        .otherwise(DEFAULT_SIZE)
    )
