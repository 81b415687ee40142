"""Quality rules with thresholds that adapt to language and source.

Fixed rules catch texts that are too short or repeat themselves. Everything else is judged against
the documents of the same language and source: each rate is sketched as counts of per-mille values,
a quantile sketch that merges by addition (absolute error at most 1 per mille), and a document is
turned down if a rate exceeds the upper quartile by ``SPREAD`` interquartile ranges and a margin.
Limits shrink towards those of the merged sketches: a language's limit is the mean of its own, weighted
by its documents, and that of all, weighted as ``PARENT`` documents; a group's in the same way of its
own and its language's. So no size of a group changes the rule, and one more document changes little.

Native throughout. NULL text counts as empty, NULL language or source as a value of its own; equal
rows are judged alike; an empty table gives an empty result; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcat.llm.common import SPACE, if_small, let, words
from loomcat.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
PARENT = 200  # documents that the limit of the next larger group weighs as
SPREAD = 3
#: Per mille that a rate may exceed the fence of its group, so that uniform groups keep odd documents.
MARGIN = {"symbol_rate": 20, "dup_line_rate": 400, "repeat_rate": 300}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated(w: Column) -> Column:
    """Words within three-word windows that occur twice or more."""

    def covered(keys: Column) -> Column:
        return let(
            F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
            lambda s: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, j: F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
                            | F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False)),
                        ),
                        lambda x: x["i"],
                    )
                ),
                lambda at: F.aggregate(
                    F.transform(
                        at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))
                    ),
                    F.lit(0),
                    lambda a, x: a + x,
                ),
            ),
        )

    windows = F.transform(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
    )
    return let(
        windows,
        lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)),
    )


def measure(docs: DataFrame) -> DataFrame:
    """The documents with the base counts and the rates that the sketches hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeated(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")
        ),
    )

    def rate(part: str, whole: str) -> Column:
        return F.floor(1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("int")

    return (
        docs.withColumns({"_counts": counts, "_lines": by_line})
        .withColumns(
            {
                "n_words": F.col("_counts.n_words").cast("long"),
                "word_chars": F.col("_counts.word_chars").cast("long"),
                "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_dup_lines": F.col("_lines.n_dup_lines").cast("long"),
                "n_repeat_words": F.col("_counts.n_repeat_words").cast("long"),
                "_n_lines": F.col("_lines.n_lines"),
            }
        )
        .withColumns(
            {
                "base_failed": (F.col("n_words") < MIN_WORDS)
                | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
                "symbol_rate": rate("n_symbols", "word_chars"),
                "dup_line_rate": rate("n_dup_lines", "_n_lines"),
                "repeat_rate": rate("n_repeat_words", "n_words"),
                "_lang": F.coalesce(F.col("lang"), F.lit("\0")),
                "_source": F.coalesce(F.col("source"), F.lit("\0")),
            }
        )
        .drop("_counts", "_lines", "_n_lines")
    )


def sketch(measured: DataFrame) -> DataFrame:
    """Counts of per-mille values by language, source and rate: at most 1001 cells for each.

    Documents that failed the base rules are left out; they would shift the quartiles.
    """
    return (
        measured.filter(~F.col("base_failed"))
        .select(
            "_lang",
            "_source",
            F.explode(
                F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in MARGIN])
            ).alias("x"),
        )
        .groupBy("_lang", "_source", F.col("x.metric").alias("metric"), F.col("x.value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def _fences(cells: DataFrame, by: list[str]) -> DataFrame:
    """Fence of each rate from the sketches merged to ``by``, one row a group."""
    merged = cells.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    placed = merged.withColumns(
        {"upto": F.sum("n").over(group.orderBy("value")), "all": F.sum("n").over(group)}
    )
    quartiles = placed.groupBy(*by, "metric").agg(
        F.max("all").alias("n"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("value"))).alias("q3"),
    )
    margin = F.create_map(*[F.lit(x) for m in MARGIN.items() for x in m])
    fence = F.col("q3") + SPREAD * (F.col("q3") - F.col("q1")) + margin[F.col("metric")]
    return quartiles.withColumn("fence", fence).groupBy(*by).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"max_{m}") for m in MARGIN],
    )


def thresholds(cells: DataFrame) -> DataFrame:
    """One row per language and source, with its fences shrunk towards those of the larger groups."""
    cells = materialize(cells, "sketch")
    own = _fences(cells, ["_lang", "_source"])
    lang = _fences(cells, ["_lang"]).select("_lang", F.struct("n", *_names()).alias("_of_lang"))
    every = _fences(cells.withColumn("_all", F.lit(1)), ["_all"])
    every = every.select("_all", F.struct("n", *_names()).alias("_of_all"))
    shrunk = "({n} * {own} + {weight} * {parent}) div ({n} + {weight})"
    limits = []
    for name in _names():
        of_lang = shrunk.format(n="_of_lang.n", own=f"_of_lang.{name}", weight=PARENT, parent=f"_of_all.{name}")
        limits.append(F.expr(shrunk.format(n="n", own=name, weight=PARENT, parent=f"({of_lang})")).alias(name))
    return own.join(lang, "_lang").withColumn("_all", F.lit(1)).join(every, "_all").select("_lang", "_source", *limits)


def _names() -> list[str]:
    return [f"max_{m}" for m in MARGIN]


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``kept`` and the limits that were applied.

    A group whose documents all failed the base rules has no limits; its documents have failed too.
    """
    over = F.lit(False)
    for m in MARGIN:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return measured.join(limits, ["_lang", "_source"], "left").withColumn(
        "kept", ~F.col("base_failed") & ~over
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Base counts, rates, limits and verdict of every document, without its text."""
    docs = docs.select("doc_id", "text", "lang", "source")
    measured = materialize(measure(docs).drop("text"), "quality")
    limits = if_small(thresholds(sketch(measured)), "limits")
    return judge(measured, limits).drop("_lang", "_source")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that keep their place, with their own columns.

    The counts are computed again where the texts are read, because carrying the texts through a
    join on the document's id would shuffle the whole corpus.
    """
    own = docs.columns
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    texts = texts.select("_row", *[F.col(f"_row.{c}").alias(c) for c in ("text", "lang", "source")])
    measured = measure(texts)
    thin = materialize(measure(docs.select("text", "lang", "source")).drop("text"), "quality")
    limits = if_small(thresholds(sketch(thin)), "limits")
    return judge(measured, limits).filter("kept").select("_row.*")
