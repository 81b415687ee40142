"""Price texts, discounts and stock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomcat.functions.text import first_word, round_2dp, strip, to_amount, to_double

# Fixed values of the price texts.
NO_PRICE = "N/A"
MARK_A = "Rs."
MARK_B = "PKR"


def price_text(price: Column) -> Column:
    return F.coalesce(price, F.lit(NO_PRICE))


def marked_amount(text: Column) -> Column:
    """First word after the first currency mark; empty when nothing follows it."""
    return first_word(F.split_part(text, F.lit(MARK_A), F.lit(2)))


def bad_original_price(text: Column) -> Column:
    """The currency mark is there but no amount: such a tile is left out."""
    return F.coalesce(text.contains(MARK_A) & (marked_amount(text) == ""), F.lit(False))


def original_price_text(text: Column, price: Column) -> Column:
    """Struck-out price reduced to mark and amount; the price itself when there is none."""
    return (
        F.when(text.isNull(), price)
        .when(text.contains(MARK_A), F.concat(F.lit(MARK_A), marked_amount(text)))
        .otherwise(first_word(text))
    )


def _bare_a(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK_A), F.lit("")), F.lit(","), F.lit(""))


def discount_int(original: Column, price: Column) -> Column:
    """Whole percent, half to even; NULL if unknown, equal as text, unreadable or original <= 0."""
    was, now = to_amount(_bare_a(original)), to_double(_bare_a(price))
    percent = F.try_divide(was - now, was) * F.lit(100.0)
    return F.when(original != price, F.bround(percent, 0).try_cast("int"))


def on_sale_a(discount: Column) -> Column:
    return F.coalesce(discount > 0, F.lit(False))


def price_text_b(text: Column) -> Column:
    """Price without its currency mark; only marked texts are trimmed again."""
    return F.when(text.contains(MARK_B), strip(F.replace(text, F.lit(MARK_B), F.lit("")))).otherwise(
        text
    )


def percent_off(current: Column, original: Column) -> Column:
    """Percent below the original to two decimals, 0 when there is no difference."""
    percent = F.try_divide(original - current, original) * F.lit(100.0)
    return F.when((original > 0) & (original != current), round_2dp(percent)).otherwise(F.lit(0.0))


def stock_flag(available: Column, status: Column) -> Column:
    """Availability, overridden by an explicit status."""
    return (
        F.when(status == "IN_STOCK", F.lit(True))
        .when(status == "OUT_OF_STOCK", F.lit(False))
        .otherwise(available)
    )
