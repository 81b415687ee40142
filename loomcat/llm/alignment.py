"""Alignment of two tokenizers over the corpus, each distinct text once.

The texts are shuffled by their full text, so that copies meet and leave one row with their number.
Each distinct text is encoded by both tokenizers; byte offsets at which tokens of both end cut it into
groups, and every stretch between two neighbouring ends links the one token of each that covers it.
A pair of linked ids counts once per text, weighted by the text's copies. The text's measures over
those counts are then summed and joined to the documents by the text's SHA-256.

Pair counts meet the texts' pairs in two ways, so that no pair is hot in a shuffle: at most ``FREQUENT``
pairs, those above a count taken from a histogram, are a table of fixed size in every worker; all the
others are joined. Texts of which more than one in ``SHARES`` documents is a copy, fewer than ``SHARES`` by
their definition, are joined to their documents by broadcast.

NULL and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros
and an empty group string. Rows with a NULL id stay; repeated rows each get a row; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.llm.byte_bpe import ByteBpe, vocabulary
from loomcat.llm.common import bound_batches
from loomcat.session import materialize

FREQUENT = 1 << 19  # pairs of 13 bytes
SHARES = 1000
_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_HELD = 1 << 21  # pairs that a task holds before it sends their counts on


class Aligner:
    """Both tokenizers, the bytes of their tokens, and their ids as text."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        self._a = ByteBpe(byte_level, special=False)
        self._b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.width = self._b.get_piece_size()
        a = {i: token for token, i in vocabulary(byte_level).items()}
        self._bytes_a = [a.get(i, b"") for i in range(max(a) + 1)]
        self._bytes_b = [self._piece(i) for i in range(self.width)]
        self._sizes_a = np.array([len(x) for x in self._bytes_a])
        self._sizes_b = np.array([len(x) for x in self._bytes_b])
        names = [str(i) for i in range(max(len(self._bytes_a), self.width))]
        #: An id with what follows it: the next id of its side, the group's other side, the next group.
        self._marked = [name + mark for mark in ",|;" for name in names]
        self._step = len(names)

    def _piece(self, number: int) -> bytes:
        piece = self._b.id_to_piece(number)
        if self._b.is_byte(number):
            return bytes([int(re.fullmatch("<0x(..)>", piece)[1], 16)])
        return piece.replace("▁", " ").encode()

    def align(self, text: str) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, str] | None:
        """Both sides' ids, the number of groups, the links as ``a * width + b``, and the groups as text."""
        whole = " " + text
        ids_a, ids_b = self._a.encode(whole), self._b.encode(text, num_threads=1)
        expected = whole.encode()
        if b"".join(map(self._bytes_a.__getitem__, ids_a)) != expected:
            return None
        if b"".join(map(self._bytes_b.__getitem__, ids_b)) != expected:
            return None
        a, b = np.array(ids_a), np.array(ids_b)
        ends_a, ends_b = self._sizes_a[a].cumsum(), self._sizes_b[b].cumsum()
        ends = np.union1d(ends_a, ends_b)
        links = a[np.searchsorted(ends_a, ends)] * self.width + b[np.searchsorted(ends_b, ends)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        return a, b, len(cuts), links, self._groups(a, b, ends_a, ends_b, cuts)

    def _groups(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray) -> str:
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        # Within a group all its A ids come first, then its B ids.
        at_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")
        marked = np.empty(len(a) + len(b), np.int64)
        marked[at_a] = a + self._step * np.append(group_a[1:] != group_a[:-1], True)
        marked[at_b] = b + 2 * self._step * np.append(group_b[1:] != group_b[:-1], True)
        return "".join(map(self._marked.__getitem__, marked.tolist()))[:-1]


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = codes.argsort(kind="stable")
    codes, weights = codes[order], weights[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[first], np.add.reduceat(weights, first) if len(first) else weights


def _pairs(packed: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and numbers of links of all rows of packed pairs, and how many pairs each row has."""
    rows = [np.frombuffer(x, np.uint32) for x in packed.to_pylist()]
    sizes = np.array([len(x) // 2 for x in rows], np.int64)
    codes = np.concatenate([np.zeros(0, np.uint32), *(x[: len(x) // 2] for x in rows)]).astype(np.int64)
    times = np.concatenate([np.zeros(0, np.uint32), *(x[len(x) // 2 :] for x in rows)]).astype(np.int64)
    return codes, times, sizes


def aligned_texts(
    docs: DataFrame, byte_level_path: str, pieces_path: str, describe: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One row per distinct text: its key, copies, measures, ``groups`` and packed pairs of linked ids.

    ``groups`` is text such as ``a1,a2|b1;a3|b2,b3``; ``describe`` turns it into something shorter before
    it is stored. ``pairs`` holds the distinct codes and then their numbers of links, as 32-bit numbers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(byte_level_path, encoding="utf-8") as file:
        byte_level = spark.sparkContext.broadcast(file.read())
    with open(pieces_path, "rb") as file:
        pieces = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level.value, pieces.value)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                rows = []
                for text in batch["text"].to_pylist():
                    found = aligner.align(text)
                    if found is None:
                        rows.append((0, 0, 0, 0, "", b""))
                        continue
                    a, b, groups, links, string = found
                    codes, times = np.unique(links, return_counts=True)
                    packed = codes.astype(np.uint32).tobytes() + times.astype(np.uint32).tobytes()
                    rows.append((len(a), len(b), groups, len(links), string, packed))
                columns = zip(*rows, strict=True)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.record_batch(
                    [batch["key"], batch["copies"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["key", "copies", *_MEASURES, "groups", "pairs"],
                )

    texts = (
        docs.filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(_key(), "copies", "text")
    )
    schema = "key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary"
    found = texts.mapInArrow(run, schema)
    if describe is not None:
        found = found.withColumn("groups", describe(F.col("groups")))
    return materialize(found, "aligned-texts")


def _key() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("key")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``code``, ``n`` documents that hold the pair linked, and whether its first id has no pair with more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                more, _, sizes = _pairs(part["pairs"])
                copies = np.repeat(part["copies"].to_numpy(), sizes)
                codes, weights = _summed(np.append(codes, more), np.append(weights, copies))
                if len(codes) > _HELD:
                    yield pa.record_batch({"code": pa.array(codes), "n": pa.array(weights)})
                    codes, weights = codes[:0], weights[:0]
        yield pa.record_batch({"code": pa.array(codes), "n": pa.array(weights)})

    counted = aligned.select("copies", "pairs").mapInArrow(count, "code long, n long")
    pairs = materialize(counted.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    first = F.expr(f"code div {width}").alias("first")
    # One row for each id of a vocabulary: a table whose size the vocabulary bounds.
    best = F.broadcast(pairs.groupBy(first).agg(F.max("n").alias("most")))
    return pairs.join(best, first == best["first"]).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent(pairs: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """The pairs with their bucket of counts, and the lowest bucket so that at most ``bound`` pairs reach it."""
    pairs = materialize(pairs.withColumn("level", F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")), "pairs")
    levels = sorted(pairs.groupBy("level").count().collect(), reverse=True)  # at most 8 * 63 rows
    cut, held = 1 << 30, 0
    for level, number in levels:
        held += number
        if held > bound:
            break
        cut = level
    return pairs, cut


def align(
    docs: DataFrame,
    byte_level_path: str,
    pieces_path: str,
    describe: Callable[[Column], Column] | None = None,
    frequent: int = FREQUENT,
    shares: int = SHARES,
) -> DataFrame:
    """Per document: ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups``."""
    spark = docs.sparkSession
    width = sentencepiece.SentencePieceProcessor(model_file=pieces_path).get_piece_size()
    aligned = aligned_texts(docs, byte_level_path, pieces_path, describe)
    pairs, cut = _frequent(pair_counts(aligned, width), frequent)
    table = pairs.filter(F.col("level") >= cut).select("code", "n", "best").toArrow().sort_by("code")
    known = spark.sparkContext.broadcast([table[c].to_numpy() for c in ("code", "n", "best")])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, best = known.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                part = whole.slice(begin, 500)
                codes, times, sizes = _pairs(part["pairs"])
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.minimum(np.searchsorted(held, codes), max(len(held) - 1, 0))
                hit = held[at] == codes if len(held) else np.zeros(len(codes), bool)
                sums, bests = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
                np.add.at(sums, row[hit], times[hit] * counts[at[hit]])
                np.add.at(bests, row[hit], times[hit] * best[at[hit]])
                rest, none = np.flatnonzero(~hit), np.zeros(len(sizes), np.int64)
                take = pa.array(np.append(np.arange(len(sizes)), row[rest]))
                # The row of a text itself has a code of its own below zero, so that these are spread.
                own = -1 - (np.frombuffer(b"".join(k[:7] + b"\0" for k in part["key"].to_pylist()), "<i8"))
                yield pa.record_batch(
                    {
                        "key": part["key"].take(take),
                        "code": pa.array(np.append(own, codes[rest])),
                        "times": pa.array(np.append(none, times[rest])),
                        "known_best": pa.array(np.append(bests, 0 * rest)),
                        "known_sum": pa.array(np.append(sums, 0 * rest)),
                    }
                )

    links = aligned.select("key", "pairs").mapInArrow(
        measure, "key binary, code long, times long, known_best long, known_sum long"
    )
    rare = pairs.filter(F.col("level") < cut).select("code", "n", "best")
    counted = links.join(rare, "code", "left")
    own = F.col("times") * F.coalesce("n", F.lit(0))
    summed = counted.groupBy("key").agg(
        F.sum(F.col("known_best") + F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("known_sum") + own).alias("count_sum"),
    )
    texts = materialize(aligned.drop("pairs").join(summed, "key"), "text-measures")
    return _to_documents(docs, texts, shares)


def _to_documents(docs: DataFrame, texts: DataFrame, shares: int) -> DataFrame:
    """The measures of every document's text."""
    total = texts.agg(F.sum("copies")).first()[0] or 0
    often = F.col("copies") * shares > total
    columns = [*_MEASURES, "n_best", "count_sum"]
    keyed = docs.select("doc_id", F.when(F.col("text") != "", _key()).alias("key"))
    often_keys = F.broadcast(texts.filter(often).select(F.col("key").alias("often")))
    marked = keyed.join(often_keys, F.col("key") == F.col("often"), "left")
    many = marked.filter("often IS NOT NULL").drop("often").join(F.broadcast(texts.filter(often)), "key")
    # Documents without text have no partner; a key of their own each keeps them apart.
    few = marked.filter("often IS NULL").withColumn(
        "key", F.coalesce("key", F.unhex(F.hex(F.xxhash64("doc_id"))))
    ).drop("often").join(texts.filter(~often), "key", "left")
    out = ["doc_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns)]
    out.append(F.coalesce("groups", F.lit("")).alias("groups"))
    return many.select(*out).unionAll(few.select(*out))
