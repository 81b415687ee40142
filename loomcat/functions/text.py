"""Whitespace, words, title case and numeric parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters treated as whitespace when trimming and splitting, those with the
# Unicode property and four separators. Patterns using it start with the flag for the property.
UNICODE = "(?U)"
SPACE = r"[\s\x1C-\x1F]"

_CASED_RUNS = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"
_UNSIGNED = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(text, rf"{UNICODE}\A{SPACE}+|{SPACE}+\z", "")


def squeeze(text: Column) -> Column:
    """Trim and turn each whitespace run into one space."""
    return F.trim(F.regexp_replace(text, f"{UNICODE}{SPACE}+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.array_remove(F.split(text, f"{UNICODE}{SPACE}+"), "")


def first_word(text: Column) -> Column:
    return F.split(squeeze(text), " ")[0]


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case elsewhere (``initcap`` only follows spaces)."""
    runs = F.regexp_extract_all(text, F.lit(_CASED_RUNS), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def slug(text: Column) -> Column:
    """Lower case with each space as a hyphen."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("-"))


def contains_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | text.contains(needle)
    return found


def to_double(text: Column) -> Column:
    """Number or NULL; refuses NaN, infinities and type suffixes that a plain cast would take."""
    return _matching(text, f"[+-]?{_UNSIGNED}").try_cast("double")


def to_amount(text: Column) -> Column:
    """As ``to_double``, without negative numbers."""
    return _matching(text, rf"\+?{_UNSIGNED}").try_cast("double")


def to_int(text: Column) -> Column:
    return _matching(text, r"[+-]?[0-9]+").try_cast("int")


def _matching(text: Column, pattern: str) -> Column:
    """The trimmed text if all of it matches, else an empty text, which no number cast takes."""
    return F.regexp_extract(text, rf"{UNICODE}\A{SPACE}*({pattern}){SPACE}*\z", 1)


def round_2dp(value: Column) -> Column:
    """Round a double to two decimals by its exact binary value, ties to even.

    ``round`` and ``bround`` decide on the printed decimal instead, so 2.675 (binary just below
    the tie) and 0.125 (an exact tie) would come out differently. The value is split into a
    float part and a remainder so that 200 * value is exact when compared with the midpoint.
    """
    high = value.cast("float").cast("double")
    low = value - high
    cents = F.floor(value * F.lit(100.0))
    side = (high * 200.0 - (cents * 2 + 1)) + low * 200.0
    up = F.when(side > 0, F.lit(1)).when(side < 0, F.lit(0)).otherwise(F.abs(cents % 2))
    return ((cents + up) / F.lit(100.0)).cast("double")
