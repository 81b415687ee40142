"""Line deduplication that also catches lines one word apart.

Lines are compared as lower-case words. A line goes if the same words stand in an earlier line, or,
for lines of ``MIN_WORDS`` words and more, if an earlier line is one inserted, deleted or replaced
word away. Earlier means a smaller (document id, line number); the earliest line stays.

Near lines are found through deletion neighbourhoods: two lines a replacement apart are equal once
that word is deleted from both, and a line a deletion away equals a variant of the longer one.
Variants are emitted as hashed keys; equal keys meet in a join, where each line sees only the earliest
of its key, never all pairs. One pair per line is then verified by edit distance. One edit leaves the
first or the last half of the words alone, halves of the shorter line's length. So only lines that
share such a half with another line of a fitting length emit variants, and only those that delete a
word outside the shared half. A line of ``MIN_WORDS`` words may go for an earlier one that is a word
shorter. Equal lines are folded first.

Texts are shuffled compressed. Blank lines always stay. NULL texts have no lines and stay NULL;
repeated rows share their places, so neither removes the other's lines; an empty table gives an
empty result; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomcat.llm.common import bound_batches
from loomcat.session import materialize

MIN_WORDS = 10
# What a line shares halves for: a word replaced or deleted after its first half, or before its last one.
_REPLACE_LATE, _REPLACE_EARLY, _DELETE_LATE, _DELETE_EARLY, _WHOLE = 1, 2, 4, 8, 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _line_hash(words: list[str]) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest("\0".join(words))
    return _signed(both >> 64), _signed(both & (1 << 64) - 1)


def _end_hash(words: list[str], tag: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(tag + "\0".join(words)))


_HALVES = ["head", "tail", "short_head", "short_tail"]
_PLACES = "doc_id long, at int, h1 long, h2 long, head long, tail long, short_head long, short_tail long"


def _half_hashes(words: list[str]) -> tuple[int | None, ...]:
    """First and last half as shared with lines of this length or more, and with shorter ones."""
    n = len(words)
    if n < MIN_WORDS - 1:
        return (None,) * 4
    found = [_end_hash(words[: n // 2], f"h{n}"), _end_hash(words[-(n // 2) :], f"t{n}")]
    if n < MIN_WORDS:
        return *found, None, None
    k = (n - 1) // 2
    return *found, _end_hash(words[:k], f"h{n - 1}"), _end_hash(words[-k:], f"t{n - 1}")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
    names = ["doc_id", "at", "h1", "h2", *_HALVES]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            for at, line in enumerate((text or "").split("\n")):
                words = line.lower().split()
                if words:
                    rows.append((doc_id, at, *_line_hash(words), *_half_hashes(words)))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _packed(docs: DataFrame) -> DataFrame:
    """The rows with their text compressed."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("struct<x:int>")
    rows = docs.select("doc_id", "text", rest.alias("_rest"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("_z", T.BinaryType()), rows.schema["_rest"]])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch["text"].to_pylist()
            small = pa.array([None if t is None else press(t.encode()) for t in texts], pa.binary())
            yield pa.record_batch([batch["doc_id"], small, batch["_rest"]], names=["doc_id", "_z", "_rest"])

    return rows.mapInArrow(squeeze, schema)


def _deletions(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hash of a sequence without each of its members, and of the whole sequence."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n + 1, _FACTOR))
        terms = hashes * powers[:n]
        before = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
        # After a deletion the later members move up by one place: their terms lose one factor.
        moved = np.concatenate([[np.uint64(0)], np.cumsum(hashes[1:] * powers[: n - 1], dtype=np.uint64)])
        return before[:n] + (moved[n - 1] - moved[:n]), before[n:]


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the wanted lines: ``role`` 0 with a word replaced, 1 with a word deleted, 2 whole, 4
    whole but too short to go; role 3 has the words.
    """
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        ids, ats, keys, roles, hashed = [], [], [], [], []
        for doc_id, z, wanted in zip(*(batch[c].to_pylist() for c in ("doc_id", "_z", "_wanted")), strict=True):
            lines = unpack(z).decode().split("\n")
            asked: dict[tuple[int, int], int] = {}
            for want in wanted:
                asked[want["at"], want["h1"]] = asked.get((want["at"], want["h1"]), 0) | want["what"]
            for (at, h1), what in asked.items():
                words = lines[at].lower().split() if at < len(lines) else []
                if not words or _line_hash(words)[0] != h1:
                    continue  # another row with this id
                n = len(words)
                h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
                deleted, whole = _deletions(h)
                late, early = n // 2 if what & _REPLACE_LATE else n, n // 2 if what & _REPLACE_EARLY else 0
                at_words = np.concatenate([np.arange(early), np.arange(late, n)])
                with np.errstate(over="ignore"):
                    place = (at_words + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                    replaced = deleted[at_words] ^ (place << np.uint64(1) | np.uint64(1))
                half = (n - 1) // 2
                late, early = half if what & _DELETE_LATE else n, half if what & _DELETE_EARLY else 0
                once = np.unique(np.concatenate([deleted[:early], deleted[late:]]))
                whole = whole if what & _WHOLE else whole[:0]
                found = np.concatenate([replaced, once, whole])
                keys.append(found.view(np.int64))
                roles.append(np.repeat([0, 1, 2 if n >= MIN_WORDS else 4], [len(replaced), len(once), len(whole)]))
                ids.extend([doc_id] * len(found))
                ats.append(np.full(len(found), at, np.int32))
                hashed.append((doc_id, at, (h >> np.uint64(1)).view(np.int64)))
        if keys:
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "at": pa.array(np.concatenate(ats), pa.int32()),
                    "role": pa.array(np.concatenate(roles), pa.int32()),
                    "key": pa.array(np.concatenate(keys), pa.int64()),
                    "words": pa.nulls(len(ids), pa.list_(pa.int64())),
                }
            )
            yield pa.record_batch(
                {
                    "doc_id": pa.array([x[0] for x in hashed], pa.int64()),
                    "at": pa.array([x[1] for x in hashed], pa.int32()),
                    "role": pa.array([3] * len(hashed), pa.int32()),
                    "key": pa.nulls(len(hashed), pa.int64()),
                    "words": pa.array([x[2] for x in hashed], pa.list_(pa.int64())),
                }
            )


def _one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = []
        for a, b in zip(batch["words"].to_pylist(), batch["their_words"].to_pylist(), strict=True):
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            a, b = a[n:], b[n:]
            near.append(
                len(a) == len(b) and a[1:] == b[1:] or len(a) == len(b) + 1 and a[1:] == b
                or len(b) == len(a) + 1 and b[1:] == a
            )
        yield batch.select(["doc_id", "at"]).filter(pa.array(near, pa.bool_()))


def _near_lines(firsts: DataFrame, packed: DataFrame) -> DataFrame:
    """Places of distinct lines that have an earlier line one word away."""
    short = F.col("short_head").isNull()  # such lines cannot go, but longer ones can for them
    ends = firsts.filter(F.col("head").isNotNull()).select(
        "first", "h1", short.alias("short"), F.posexplode(F.array(*_HALVES)).alias("half", "end")
    )
    ends = ends.filter(F.col("end").isNotNull())
    longer = F.col("half") > 1
    shared = ends.groupBy("end").agg(F.count_if(~longer).alias("same"), F.count_if(longer).alias("longer"))
    shared = shared.filter("same > 1 or same > 0 and longer > 0")
    replace = F.when(F.col("half") == 0, _REPLACE_LATE).otherwise(_REPLACE_EARLY)
    delete = F.when(F.col("half") == 2, _DELETE_LATE).otherwise(_DELETE_EARLY)
    own = F.when(~F.col("short") & (F.col("same") > 1), replace).otherwise(0)
    what = F.when(longer, delete).otherwise(own + F.when(F.col("longer") > 0, _WHOLE).otherwise(0))
    wanted = (
        ends.join(shared, "end")
        .select("first.doc_id", F.struct("first.at", "h1", what.alias("what")).alias("x"))
        .filter("x.what > 0")
        .groupBy("doc_id")
        .agg(F.collect_set("x").alias("_wanted"))  # lines of one document
    )
    texts = packed.filter(F.col("_z").isNotNull()).select("doc_id", "_z")
    joined = texts.join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    found = materialize(
        joined.select("doc_id", "_z", "_wanted").mapInArrow(
            _variants, "doc_id long, at int, role int, key long, words array<long>"
        ),
        "variants",
    )
    place = F.struct("doc_id", "at").alias("place")
    replaced = found.filter("role = 0").select("key", place)
    earliest = replaced.groupBy("key").agg(F.min("place").alias("other"), F.max("place").alias("last"))
    same = replaced.join(earliest.filter("other < last").select("key", "other"), "key")
    shorter = found.filter("role in (2, 4)").select("key", "role", F.struct("doc_id", "at").alias("other"))
    longer = found.filter("role = 1").select("key", place)
    beside = longer.join(shorter, "key")
    turned = beside.filter("role = 2").groupBy(F.col("other").alias("place")).agg(F.min("place").alias("other"))
    pairs = (
        same.select("place", "other")
        .unionAll(beside.select("place", "other"))
        .unionAll(turned.select("place", "other"))
        .filter("other < place")
        .groupBy("place")
        .agg(F.min("other").alias("other"))
    )
    words = found.filter("role = 3").select(place, "words").dropDuplicates(["place"])
    theirs = words.select(F.col("place").alias("other"), F.col("words").alias("their_words"))
    checked = pairs.join(words, "place").join(theirs, "other")
    return checked.select("place.doc_id", "place.at", "words", "their_words").mapInArrow(
        _one_edit, "doc_id long, at int"
    )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents without repeated lines, with ``_n_lines`` (that hold words) and ``_n_dropped``."""
    bound_batches(docs.sparkSession)
    places = materialize(docs.select("doc_id", "text").mapInArrow(_places, _PLACES), "lines")
    place = F.struct("doc_id", "at")
    firsts = places.groupBy("h1", "h2").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), *[F.max(x).alias(x) for x in _HALVES]
    )
    firsts = materialize(firsts, "distinct-lines")
    packed = _packed(docs)
    repeated = firsts.filter("first < last").select("h1", "h2", "first")
    again = places.join(repeated, ["h1", "h2"]).filter(place != F.col("first")).select("doc_id", "at", "h1")
    near = _near_lines(firsts, packed).join(
        firsts.select("first.doc_id", "first.at", "h1"), ["doc_id", "at"]
    )
    drops = (
        again.unionAll(near.select("doc_id", "at", "h1"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_set(F.struct("at", "h1")).alias("_drops"))  # lines of one document
    )
    joined = packed.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    kinds = {f.name: f for f in joined.schema}
    schema = T.StructType(
        [
            kinds["doc_id"],
            T.StructField("text", T.StringType()),
            kinds["_rest"],
            T.StructField("_n_lines", T.LongType()),
            T.StructField("_n_dropped", T.LongType()),
        ]
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, sizes, lost = [], [], []
            for z, drops in zip(batch["_z"].to_pylist(), batch["_drops"].to_pylist(), strict=True):
                if z is None:
                    texts.append(None)
                    sizes.append(0)
                    lost.append(0)
                    continue
                text = unpack(z).decode()
                lines = text.split("\n")
                sizes.append(sum(1 for x in lines if x.split()))
                gone = {d["at"]: d["h1"] for d in drops or []}
                kept = [
                    x
                    for at, x in enumerate(lines)
                    if at not in gone or _line_hash(x.lower().split())[0] != gone[at]
                ]
                texts.append("\n".join(kept) if len(kept) < len(lines) else text)
                lost.append(len(lines) - len(kept))
            yield pa.record_batch(
                [
                    batch["doc_id"], pa.array(texts, pa.string()), batch["_rest"],
                    pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()),
                ],
                names=["doc_id", "text", "_rest", "_n_lines", "_n_dropped"],
            )

    done = joined.select("doc_id", "_z", "_rest", "_drops").mapInArrow(rebuild, schema)
    own = [c if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns]
    return done.select(*own, "_n_lines", "_n_dropped")
