"""The registered queries of the training-data operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcat.llm.alignment import align
from loomcat.llm.collocations import collocations
from loomcat.llm.decontaminate import find_leaks
from loomcat.llm.lines import drop_repeated_lines
from loomcat.llm.near_dedup import near_duplicates
from loomcat.llm.packing import pack
from loomcat.llm.pages import extract_main_text
from loomcat.llm.passages import repeated_passages
from loomcat.llm.pii import KINDS, digest, find_personal_data
from loomcat.llm.quality import quality_verdicts
from loomcat.llm.token_counts import count_tokens
from loomcat.llm.toxicity import toxicity
from loomcat.llm.word_bpe import encode

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the adaptive quality rules on every document."""
    return quality_verdicts(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "symbol_rate", "dup_line_rate", "repeat_rate",
    )


ORACLES["op5_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents
), w AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols
  FROM d
), g AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM again) GROUP BY r
), base AS (
  SELECT d.r, doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source,
    len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (1000 * n_symbols // greatest(word_chars, 1))::INT AS symbol_rate,
    (1000 * n_dup_lines // greatest(n_lines, 1))::INT AS dup_line_rate,
    (1000 * n_repeat_words // greatest(n_words, 1))::INT AS repeat_rate
  FROM base
), v AS (
  SELECT lang, source, unnest(['s', 'd', 'r']) AS k, unnest([symbol_rate, dup_line_rate, repeat_rate]) AS x
  FROM m WHERE NOT base_failed
), q AS (
  SELECT lang, source, k, count(*) AS n, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3
  FROM v GROUP BY GROUPING SETS ((lang, source, k), (lang, k), (k))
), f AS (
  SELECT lang, source, max(n) AS n,
    max(q3 + 3 * (q3 - q1) + 20) FILTER (k = 's') AS s,
    max(q3 + 3 * (q3 - q1) + 400) FILTER (k = 'd') AS d,
    max(q3 + 3 * (q3 - q1) + 300) FILTER (k = 'r') AS r
  FROM q GROUP BY lang, source
), t AS (
  SELECT o.lang, o.source,
    (o.n * o.s + 200 * ((l.n * l.s + 200 * e.s) // (l.n + 200))) // (o.n + 200) AS s,
    (o.n * o.d + 200 * ((l.n * l.d + 200 * e.d) // (l.n + 200))) // (o.n + 200) AS d,
    (o.n * o.r + 200 * ((l.n * l.r + 200 * e.r) // (l.n + 200))) // (o.n + 200) AS r
  FROM (SELECT * FROM f WHERE source IS NOT NULL) o
  JOIN (SELECT * FROM f WHERE source IS NULL AND lang IS NOT NULL) l ON o.lang = l.lang
  CROSS JOIN (SELECT * FROM f WHERE lang IS NULL) e
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_rate <= s, true) AND coalesce(dup_line_rate <= t.d, true)
    AND coalesce(repeat_rate <= t.r, true) AS kept,
  symbol_rate, dup_line_rate, repeat_rate
FROM m LEFT JOIN t USING (lang, source)
"""


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    found = find_personal_data(_documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap with benchmark items, and where."""
    return find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    return pack(_documents(spark, sf_dir), TOKENIZER)


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(_documents(spark, sf_dir), TOKENIZER)


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat earlier ones."""
    return drop_repeated_lines(_documents(spark, sf_dir)).select(
        "doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped")
    )


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four folds."""
    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_duplicates(_documents(spark, sf_dir))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document too."""
    return repeated_passages(_documents(spark, sf_dir))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the alignment of two tokenizers on every document."""

    def digest_of(groups: Column) -> Column:
        return F.when(groups == "", "").otherwise(F.sha2(groups, 256))

    aligned = align(_documents(spark, sf_dir), TOKENIZER, PIECES, describe=digest_of)
    return aligned.withColumnRenamed("groups", "groups_sha256")


@query
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text that they decode to, as digests."""
    return encode(_documents(spark, sf_dir), WORDS, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of every language."""
    return collocations(_documents(spark, sf_dir))


ORACLES["op13_collocations"] = r"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang,
    list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang
), gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM piece, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS n FROM gram GROUP BY ALL HAVING count(*) >= 100
), candidate AS (
  SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), cut AS (
  SELECT c.lang, c.phrase, c.a, c.k, cut, l.n AS l, r.n AS r, total.n AS n,
    (1000::HUGEINT * c.a * total.n) // (l.n::HUGEINT * r.n) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidate) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
  JOIN total ON total.lang = c.lang
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_part AS (
  SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, k, s, unnest(range(1, k - s + 2)) AS i
    FROM (SELECT *, unnest(range(2, k)) AS s FROM candidate WHERE k > 2))
), kept AS (
  SELECT best.* FROM best LEFT JOIN (SELECT lang, phrase, max(a) AS within FROM inner_part GROUP BY ALL) USING (lang, phrase)
  WHERE within IS NULL OR 100 * within < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""
