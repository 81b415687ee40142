"""Collocations by dynamic itemset counting: phrases of two to five words, scored per language.

The texts are written once, dealt into ``SHARDS`` shards. A scan reads one shard after the other, over
and over. Words are counted from the first shard on. A longer phrase becomes active as soon as both
phrases that it consists of but for one word have reached the threshold in the shards read so far, and
is counted from the next shard on, for one full cycle. So phrases of all lengths are counted side by
side in one shard.

These counters are kept by 64-bit hashes, so that the great many rare words and phrases cost little.
What has reached the threshold is told to the workers by a table of a fixed number of ``SLOTS``: a
phrase's slot holds the step after which it, or another phrase of that slot, did. Equal hashes and
shared slots can only make phrases reach it that do not. Each phrase that has reached it is therefore
counted once more for one full cycle, by its own words. These counts are exact, phrases that miss the
threshold drop out, and the scan ends when no phrase can be within a cycle any more.

NULL texts count as empty, a NULL language as ``und``; repeated rows count each; texts without words
and an empty table give no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomcat.llm.common import bound_batches
from loomcat.session import materialize, scratch_path

LONGEST = 5
THRESHOLD = 100
TOP = 2000
SHARDS = 3
SLOTS = 1 << 24
_UNREACHED = 255
_BYTES = 3 << 20  # bytes of texts that are counted together, unless a single text has more
_HASHED = 1 << 16  # words hashed at once, to bound memory
_COUNTS = "key long, lang string, phrase string, n long, last int"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.isin(np.arange(256), [9, 32])  # fixed values: what separates words
_BREAK = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])  # fixed values: what separates pieces
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """All words of the texts, the number of the text of each, and the number of its piece."""
    data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    cut = _BREAK[data]
    inside = ~(cut | _GAP[data])
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = np.flatnonzero(starts)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    breaks = np.flatnonzero(cut)
    words = data[inside]
    ends = inside  # a word ends where the next place is outside
    ends[:-1] &= ~inside[1:]
    sizes = np.flatnonzero(ends) + 1 - first
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(words.tobytes()))
    return strings, np.searchsorted(bounds, first, "right"), np.searchsorted(breaks, first)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Place of a hash in the table; Spark finds the same by ``pmod`` of the signed number."""
    return np.mod(hashes.view(np.int64), slots)


def _word_hash(strings: pa.StringArray) -> np.ndarray:
    """Hash of each string; equal everywhere for equal strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    raw = strings.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out = np.zeros(len(strings), np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(strings), _HASHED):
            bounds = offsets[begin : begin + _HASHED + 1].astype(np.int64)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            sizes, starts = sizes[some], bounds[some] - bounds[0]
            powers = np.cumprod(np.full(int(sizes.max()) + 1, _P1))
            place = np.arange(bounds[-1] - bounds[0]) - np.repeat(starts, sizes)
            terms = (data[bounds[0] : bounds[-1]] + np.uint64(1)) * powers[place]
            hashed = np.add.reduceat(terms, starts)
            out[begin + some] = (hashed ^ (hashed >> np.uint64(31))) * _P2
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase, from that of its words but the last and that of the last one."""
    mixed = ((left ^ (left >> np.uint64(31))) * _P1 + right) * _P2
    return mixed ^ (mixed >> np.uint64(32))


def count_phrases(
    texts: list[bytes], langs: list[str], reached: np.ndarray, step: int, shards: int
) -> tuple[list[tuple], list[tuple]]:
    """Counters of this step by hash (key, number, last step) and by words (lang, phrase, number, last step).

    All words of a language count as its empty phrase, which never ends.
    """
    words, of_text, piece = words_of(texts)
    if not len(words):
        return [], []
    names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    lang = lang_of[of_text]
    hashed, exact = [], []
    with np.errstate(over="ignore"):
        word_hash = _word_hash(words)
        hashes = _joined((_word_hash(pa.array(names.tolist(), pa.string())) * _P2)[lang], word_hash)
        known = reached[_slot(hashes, len(reached))].astype(np.int64)
        usable = known < _UNREACHED
        if step < shards:
            fresh = hashes[~usable]
            hashed.append(_hash_rows(fresh, np.full(len(fresh), shards - 1)))
            everything = np.bincount(lang, minlength=len(names))
            empty = pa.array([""] * len(names), pa.string())
            never = pa.array(np.full(len(names), _UNREACHED, np.int32))
            exact.append((pa.array(names.tolist(), pa.string()), empty, pa.array(everything), never))
        place = np.flatnonzero(usable)
        known, hashes = known[place], hashes[place]
        # One number for each phrase of the current length that begins at a place, exact within these texts.
        coded = words.take(pa.array(place)).dictionary_encode().indices.to_numpy().astype(np.int64)
        phrase, _ = pd.factorize(coded * len(names) + lang[place])
        for length in range(1, LONGEST + 1):
            # ``place`` holds where the reached phrases of this length begin.
            due = np.flatnonzero(step <= known + shards)
            if len(due):
                exact.append(_phrase_rows(words, place[due], phrase[due], lang, names, length, known[due] + shards))
            if length == LONGEST:
                break
            follows = np.flatnonzero(place[1:] == place[:-1] + 1)
            last = place[follows] + length
            inside = piece[last] == piece[place[follows]]
            follows, last = follows[inside], last[inside]
            active = np.maximum(known[follows], known[follows + 1])
            # A phrase is known by its two overlapping parts, so these numbers stay exact.
            both = phrase[follows] * (int(phrase.max(initial=0)) + 1) + phrase[follows + 1]
            place, hashes = place[follows], _joined(hashes[follows], word_hash[last])
            own = reached[_slot(hashes, len(reached))]
            counted = (own == _UNREACHED) & (step <= active + shards)
            if counted.any():
                hashed.append(_hash_rows(hashes[counted], active[counted] + shards))
            keep = own < _UNREACHED
            # A phrase is reached when its parts are, even if another phrase has marked its slot before.
            place, hashes, known = place[keep], hashes[keep], np.maximum(own, active)[keep]
            phrase, _ = pd.factorize(both[keep])
    return hashed, exact


def _hash_rows(hashes: np.ndarray, last_step: np.ndarray) -> tuple:
    """Each hash once, how often it occurs, and the last step of its cycle."""
    number, keys = pd.factorize(hashes)
    last = np.empty(len(keys), np.int32)
    last[number] = last_step
    return pa.array(keys.view(np.int64)), pa.array(np.bincount(number, minlength=len(keys))), pa.array(last)


def _phrase_rows(
    words: pa.StringArray,
    place: np.ndarray,
    phrase: np.ndarray,
    lang: np.ndarray,
    names: np.ndarray,
    length: int,
    last_step: np.ndarray,
) -> tuple:
    """The phrases as text, by the words at one place of each, and how often each occurs."""
    number, kinds = pd.factorize(phrase)
    chosen = np.empty(len(kinds), np.int64)
    chosen[number] = np.arange(len(place))
    sample = place[chosen]
    texts = [words.take(pa.array(sample + i)) for i in range(length)]
    return (
        pa.array(names.tolist(), pa.string()).take(pa.array(lang[sample])),
        texts[0] if length == 1 else pc.binary_join_element_wise(*texts, " "),
        pa.array(np.bincount(number, minlength=len(kinds))),
        pa.array(last_step[chosen].astype(np.int32)),
    )


def _scan(shard: DataFrame, reached, step: int, shards: int) -> DataFrame:
    """Counters of one shard at one step, summed over the texts of each batch."""

    def rows(key, lang, phrase, n, last) -> pa.RecordBatch:
        blank = pa.nulls(len(n), pa.string())
        key = pa.nulls(len(n), pa.int64()) if key is None else key
        columns = [key, blank if lang is None else lang, blank if phrase is None else phrase, n, last]
        return pa.record_batch(columns, names=["key", "lang", "phrase", "n", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(reached.value), np.uint8)
        for batch in batches:
            for texts, langs in _portions(batch):
                hashed, exact = count_phrases(texts, langs, table, step, shards)
                for key, n, last in hashed:
                    yield rows(key, None, None, n, last)
                for lang, phrase, n, last in exact:
                    yield rows(None, lang, phrase, n, last)

    return shard.select("lang", "text").mapInArrow(run, _COUNTS)


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    texts, langs, held = [], [], 0
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
        raw = text.encode()
        if texts and held + len(raw) > _BYTES:
            yield texts, langs
            texts, langs, held = [], [], 0
        texts.append(raw)
        langs.append(lang)
        held += len(raw)
    yield texts, langs


def phrase_counts(
    docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """``lang``, ``phrase`` and exact ``n`` of every word and phrase that reaches the threshold.

    The empty phrase of each language holds the number of all its words.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(
        F.coalesce("lang", F.lit("und")).alias("lang"),
        "text",
        F.expr(f"monotonically_increasing_id() % {shards}").alias("shard"),
    )
    path = scratch_path(spark, "shards")
    texts.filter("text <> ''").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    texts = spark.read.schema("lang string, text string, shard int").parquet(path)
    table = np.full(slots, _UNREACHED, np.uint8)
    counts: DataFrame | None = None
    step, latest = 0, -1
    by_hash, enough = F.col("key").isNotNull(), F.col("n") >= threshold
    while step < shards or step <= latest + shards:
        reached = spark.sparkContext.broadcast(zlib.compress(table.tobytes(), 1))
        found = _scan(texts.filter(F.col("shard") == step % shards), reached, step, shards)
        both = found if counts is None else counts.unionAll(found)
        summed = both.groupBy("key", "lang", "phrase").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        # A counter by hash is done with when it reaches the threshold; it stays for this step's table.
        alive = (F.col("last") > step) | enough
        counts = materialize(summed.filter(alive), "phrases")
        slot = F.expr(f"cast(pmod(key, {slots}) AS int)").alias("slot")
        # At most one number for each slot comes back.
        fresh = counts.filter(by_hash & enough).select(slot).distinct().toArrow()["slot"].to_numpy()
        fresh = fresh[table[fresh] == _UNREACHED]
        if len(fresh):
            table[fresh] = step
            latest = step
        counts = counts.filter(~(by_hash & enough))
        reached.unpersist()
        step += 1
    return counts.filter("lang IS NOT NULL").select("lang", "phrase", "n")


def _decimal(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, shards: int = SHARDS, slots: int = SLOTS
) -> DataFrame:
    """The first ``top`` phrases of each language by score: ``lang, rank, phrase, a, l, r, n, score``."""
    return scored(phrase_counts(docs, threshold, shards, slots), top)


def scored(counts: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language, from the counts of all that reach the threshold."""
    totals = counts.filter("phrase = ''").select("lang", F.col("n").alias("total"))
    enough = counts.filter("phrase <> ''")
    parts = F.size(F.split("phrase", " "))
    candidates = enough.select("lang", parts.alias("words"), "phrase", F.col("n").alias("a")).filter("words > 1")
    split = candidates.select("*", F.split("phrase", " ").alias("w"))

    def part(begin, size) -> Column:
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = split.select("lang", "phrase", "a", "w", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest")
    )
    sizes = enough.select("lang", "phrase", "n")
    cuts = cuts.join(sizes.toDF("lang", "head", "l"), ["lang", "head"]).join(sizes.toDF("lang", "rest", "r"), ["lang", "rest"])
    cuts = cuts.join(totals.withColumnRenamed("total", "n"), "lang")
    ratio = F.call_function("div", _decimal("a") * 1000 * _decimal("n"), _decimal("l") * _decimal("r"))
    lowest = cuts.withColumn("score", ratio).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("best")
    )
    inner = split.filter("words > 2").select(
        "lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    ).select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    longer = inner.select("lang", part(F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("within")
    )
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter("within IS NULL OR 100 * within < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score"))
    )
