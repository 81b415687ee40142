"""Benchmark decontamination with spaced seeds.

A mask selects some of a few neighbouring tokens and ignores the others. The hashes of all masked
windows of the test items meet those of the training texts in a join; around each hit, item and text
are laid side by side without gaps and the equal tokens are counted. An overlap counts if some window
of ``WINDOW`` tokens on the hit's diagonal (the whole item if it is shorter) has at least ``SHARE``
per cent equal tokens. Every such window is hit: ``MASKS`` were chosen so that whatever places the
allowed substitutions take, one mask lies somewhere beside them. Items of fewer tokens have fewer
places for a mask, so they have masks of their own that select fewer tokens; texts are cut only by the
masks of the lengths that the benchmark has.

Tokens are lower-case runs of letters and digits. Items under ``MIN_TOKENS`` tokens are skipped: they
allow no substitution, and finding "yes" or "the United States" in a text tells nothing. Seeds are
broadcast in blocks of at most ``BLOCK`` rows, one pass over the texts for each block, so that neither
a large benchmark nor frequent seeds lead to a shuffle of the texts.

Native throughout. NULL and empty texts contain nothing; NULL items are skipped; repeated rows give
one result; texts may have any length; empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.llm.common import if_small, let
from loomcat.session import materialize

#: Offsets of the tokens that a mask selects, by the least and most tokens of the items it is for.
MASKS = {
    (11, 2**31 - 1): [(0, 1, 3, 5, 6, 7), (0, 1, 2, 3, 5, 6), (0, 2, 3, 6, 7, 8), (0, 1, 2, 5, 7, 10)],
    (10, 10): [(0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 3, 8, 9)],
    (5, 9): [(0, 2, 3, 4), (0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4)],
}
MIN_TOKENS = 5
WINDOW = 13
SHARE = 80
#: Tokens before a hit at which a window that covers it can begin, by the shortest mask of long items.
BEFORE = WINDOW - 1 - min(mask[-1] for mask in MASKS[11, 2**31 - 1])
BLOCK = 200_000  # seeds of some 220 bytes each when broadcast
_NUMBERED = [(sizes, mask) for sizes, masks in MASKS.items() for mask in masks]


def _tokens(text: Column) -> Column:
    """Hashes of a text's tokens."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.xxhash64(x))


def _masked(texts: DataFrame, key: str, numbers: list[int], by_size: bool = False) -> DataFrame:
    """A row for each of the masks at each place: its hash and the tokens, NULL where it does not fit.

    With ``by_size`` a text meets the masks of its own length only.
    """
    # The outer form is meant: the other adds a filter that computes the tokens once more.
    placed = texts.select(key, "_tokens", F.posexplode_outer("_tokens").alias("_at", "_token")).drop("_token")
    seeds = []
    for n in numbers:
        (least, most), mask = _NUMBERED[n]
        fits = F.col("_at") + mask[-1] < F.size("_tokens")
        if by_size:
            fits &= F.size("_tokens").between(least, most)
        chosen = [F.get(F.col("_tokens"), F.col("_at") + o) for o in mask]
        found = F.xxhash64(F.lit(n), *chosen)
        seeds.append(F.when(fits, F.struct(found.alias("key"), F.lit(mask[-1] + 1).alias("span")) if by_size else found))
    masked = placed.select(key, "_tokens", "_at", F.explode(F.array(*seeds)).alias("_key"))
    return masked.filter(F.col("_key").isNotNull())


def _near(name: str) -> Column:
    around = range(-BEFORE, WINDOW)
    return F.array(*[F.get(F.col("_tokens"), F.col("_at") + o) for o in around]).alias(name)


def _densest() -> Column:
    """Most equal tokens in a window around the hit."""
    same = F.zip_with("_hit.near", "_hit.item", lambda a, b: F.coalesce(a == b, F.lit(False)).cast("int"))
    starts = range(BEFORE + 1)
    return let(
        same,
        lambda m: F.greatest(*[reduce(Column.__add__, [F.get(m, i + o) for o in range(WINDOW)]) for i in starts]),
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item with a verified overlap.

    ``first`` and ``last`` are the document's tokens between which hits were verified, ``start`` the
    token that stands beside the item's first on the first diagonal (negative if that is cut off).
    """
    items = (
        benchmark.select("item_id", _tokens(F.col("text")).alias("_tokens"))
        .filter(F.size("_tokens") >= MIN_TOKENS)
        .distinct()
    )
    every = list(range(len(_NUMBERED)))
    seeds = materialize(
        _masked(items, "item_id", every, by_size=True).select(
            "item_id", F.col("_key.key").alias("_key"), F.col("_key.span").alias("_span"),
            F.col("_at").alias("_item_at"), _near("_item_near"), F.size("_tokens").alias("_size"),
            F.least(F.lit(WINDOW), F.size("_tokens")).alias("_window"),
        ),
        "seeds",
    )
    fitting = [F.count(F.when(F.col("_size").between(*sizes), True)) for sizes, _ in _NUMBERED]
    total, *counts = seeds.agg(F.count("*"), *fitting).first()
    used = [n for n in every if counts[n]] or every[:1]
    blocks = max(1, -(-total // BLOCK))
    block = F.pmod(F.xxhash64("_key", "item_id", "_item_at"), F.lit(blocks))
    texts = docs.select("doc_id", _tokens(F.col("text")).alias("_tokens"))
    places = _masked(texts, "doc_id", used)
    found = [
        places.join(F.broadcast(seeds.drop("_size").filter(block == b)), "_key").select(
            "doc_id", "item_id", "_at", "_span", "_item_at", "_window", "_item_near", _near("_near")
        )
        for b in range(blocks)
    ]
    return (
        reduce(DataFrame.unionAll, found)
        # Behind an explode, the test is not moved into the join, whose generated code has to stay small.
        .select(
            "doc_id", "item_id", "_at", "_span", "_item_at", "_window",
            F.explode(F.array(F.struct(F.col("_near").alias("near"), F.col("_item_near").alias("item")))).alias("_hit"),
        )
        .filter(100 * _densest() >= SHARE * F.col("_window"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.min("_at").alias("first"),
            F.max(F.col("_at") + F.col("_span") - 1).alias("last"),
            F.min(F.col("_at") - F.col("_item_at")).alias("start"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a verified overlap, with their own columns."""
    leaking = if_small(find_leaks(docs, benchmark).select("doc_id").distinct(), "leaking")
    same = leaking.withColumnRenamed("doc_id", "_leaking")
    return docs.join(same, docs["doc_id"].eqNullSafe(same["_leaking"]), "left_anti")
