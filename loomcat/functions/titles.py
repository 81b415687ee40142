"""Product titles: fabric style, fabric type and product type, and category rules on names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.functions.text import contains_any, slug, strip, title_case, words

# Fixed values of the title rules.
STYLES = ["Printed", "Embroidered", "Dyed", "Digital", "Embellished"]
PIECES = ["3 Piece", "2 Piece"]
COMPOUND_FABRICS = {"Silk": ["Raw", "Pure"], "Cotton": ["Egyptian", "Pima", "Organic"]}
SEASONS = ["Summer", "Winter", "Spring", "Fall"]


def _joined(items: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(items, start, F.greatest(length, F.lit(0))), " ")


def _last_two(items: Column, count: Column) -> Column:
    pair = F.concat_ws(" ", F.get(items, count - 2), F.get(items, count - 1))
    return F.when(count >= 2, pair)


def with_title_fields(df: DataFrame, name: str = "name") -> DataFrame:
    """Add fabric_style, fabric_type and product_type read from a title.

    A title with a hyphen puts the piece count first and style, fabric and kind after it; one
    without puts an optional style first and the kind (or piece count) last.
    """
    title = F.col(name)
    staged = df.withColumns(
        {
            "_words": words(title),
            "_tail": words(F.coalesce(F.get(F.split(title, "-"), F.lit(1)), F.lit(""))),
            "_head": strip(F.split(title, "-")[0]),
        }
    ).withColumns({"_n": F.size("_words"), "_m": F.size("_tail")})
    w, n, tail, m = F.col("_words"), F.col("_n"), F.col("_tail"), F.col("_m")
    dashed = title.contains("-")
    nothing = F.lit("")

    tail_styled = F.coalesce(F.get(tail, F.lit(0)).isin(STYLES), F.lit(False))
    head_piece = F.when(F.col("_head").isin(PIECES), F.col("_head"))
    dash_style = F.when(tail_styled, F.get(tail, F.lit(0))).otherwise(nothing)
    dash_fabric = (
        F.when(tail_styled & (m > 2), _joined(tail, 2, m - 2))
        .when(tail_styled & (m == 2), F.get(tail, F.lit(1)))
        .otherwise(nothing)
    )
    dash_type = F.coalesce(
        head_piece, F.when(tail_styled & (m > 2), F.get(tail, m - 1)), nothing
    )

    styled = F.coalesce(F.get(w, F.lit(0)).isin(STYLES), F.lit(False))
    skip = F.when(styled, F.lit(1)).otherwise(F.lit(0))
    piece = F.coalesce(_last_two(w, n).isin(PIECES), F.lit(False))
    plain_style = F.when(styled, F.get(w, F.lit(0))).otherwise(nothing)
    plain_type = (
        F.when(piece, _last_two(w, n)).when(n >= 1, F.get(w, n - 1)).otherwise(nothing)
    )
    plain_fabric = (
        F.when(piece & (n >= 4), _joined(w, skip + 1, n - 2 - skip))
        .when(~piece & (n >= 3), _joined(w, skip + 1, n - 1 - skip))
        .otherwise(nothing)
    )

    return staged.withColumns(
        {
            "fabric_style": F.when(dashed, dash_style).otherwise(plain_style),
            "fabric_type": F.coalesce(
                compound_fabric(w, n), F.when(dashed, dash_fabric).otherwise(plain_fabric)
            ),
            "product_type": F.when(dashed, dash_type).otherwise(plain_type),
        }
    ).drop("_words", "_tail", "_head", "_n", "_m")


def compound_fabric(items: Column, count: Column) -> Column:
    """Two-word fabric just before the last word, such as Raw Silk; NULL when there is none."""
    result = F.lit(None).cast("string")
    for fabric, kinds in COMPOUND_FABRICS.items():
        kind = F.get(items, count - 3)
        hit = (count >= 3) & (F.get(items, count - 2) == fabric) & kind.isin(kinds)
        result = F.when(hit, F.concat_ws(" ", kind, F.lit(fabric))).otherwise(result)
    return result


def tail_product_type(items: Column) -> Column:
    """Last two words when they give a piece count, else the last word."""
    count = F.size(items)
    return (
        F.when(_last_two(items, count).isin(PIECES), _last_two(items, count))
        .when(count >= 1, F.get(items, count - 1))
        .otherwise("")
    )


def category_from_name(name: Column) -> Column:
    """Category a product name decides on its own, else NULL."""
    return F.when(name.contains("Fabrics"), F.lit("Unstitched")).when(
        contains_any(name, ["Ready", "RTW"]), F.lit("Ready to Wear")
    )


def unify_category(category: Column) -> Column:
    """Fabrics is listed as Unstitched."""
    return F.when(category.isin("Fabrics", "fabrics"), F.lit("Unstitched")).otherwise(category)


def category_fallback(name: Column, tag_data: Column, page_category: Column) -> Column:
    """Name rule, else the category in the tile's tag data (even a null one), else the page's."""
    tagged = F.when(
        F.coalesce(F.map_contains_key(tag_data, "category"), F.lit(False)), tag_data["category"]
    ).otherwise(page_category)
    by_name = category_from_name(name)
    return unify_category(F.when(by_name.isNotNull(), by_name).otherwise(tagged))


def season_from_text(text: Column) -> Column:
    """First season named in the text, in the listed order, else empty."""
    result = F.lit("")
    for season in reversed(SEASONS):
        result = F.when(text.contains(season), F.lit(season)).otherwise(result)
    return result


def slug_a(name: Column) -> Column:
    """Hyphenated name; one pass over double hyphens, so three become two."""
    return F.replace(slug(name), F.lit("--"), F.lit("-"))


def slug_b(name: Column, brand_text: Column) -> Column:
    """Hyphenated name and brand text; an empty brand text leaves the trailing hyphen."""
    brand_slug = slug(F.replace(F.lower(brand_text), F.lit(" | "), F.lit("-")))
    return F.concat(slug(name), F.lit("-"), brand_slug)


def colors_from_sku(sku: Column) -> Column:
    """The part after the last underscore, title-cased, as a one-element array."""
    part = F.regexp_extract(sku, r"_([^_]*)\z", 1)
    return F.array_remove(F.array(title_case(part)), "")
