"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct two-word shingles. ``COLLECTION`` half keys of ``ROWS`` minimum
hashes each are computed twice over, and every left half key is combined with every right one: 144
table keys from 24 half keys. Two documents at the threshold of 0.8 share a table key unless all
left or all right half keys differ, less than four times in ten thousand; at 0.85 it is three times
in a hundred thousand. Links are confirmed on the full sets.

Documents with equal sets are folded into one first. In each bucket (documents with equal table key)
candidates are not all pairs: all members meet the smallest, then the one with most confirmed links;
after each, components are formed. Members of one component need no comparison. Members that are left
in different components are not paired either: they meet by the shingles that set them apart from
their bucket's smallest member (``_rest``), which loses no link of the bucket.

Words are separated by ASCII white space, with A-Z in lower case; a document of one word has that
word as its only shingle; documents without words have no links. NULL texts have no words; rows with
one id are one document; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomcat.llm.common import among, bound_batches, if_small
from loomcat.llm.graph import components
from loomcat.session import materialize

COLLECTION = 12
ROWS = 3
PERCENT = 80
_SLICE = 4096  # shingles hashed at once, to bound memory for long texts
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _P2
        x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (and the last ones end)."""
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)]
    space = _SPACE[data]
    starts = ~space
    starts[1:] &= space[:-1]
    at = np.flatnonzero(~space)
    first = np.flatnonzero(starts)
    begins = np.flatnonzero(starts[at])
    lengths = np.diff(np.append(begins, len(at)))
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, _P1))
        terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers[at - np.repeat(first, lengths)]
        hashed = _mix(np.add.reduceat(terms, begins)) if len(begins) else np.zeros(0, np.uint64)
    bounds = np.cumsum([1, *[len(x) + 1 for x in raw]])
    return hashed, np.searchsorted(first, bounds)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct two-word shingles."""
    h, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        pairs = _mix(h[:-1] * _P1 + (h[1:] ^ (h[1:] >> np.uint64(17))) * _P2)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        out.append(_mix(h[begin:end]) if end - begin < 2 else np.unique(pairs[begin : end - 1]))
    return out


_turn = np.random.default_rng(20)
_A = _turn.integers(0, 2**63, 2 * COLLECTION * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _turn.integers(0, 2**63, 2 * COLLECTION * ROWS, np.uint64)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """Left and right half keys of a set."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for begin in range(0, len(shingles), _SLICE):
            hashed = shingles[begin : begin + _SLICE, None] * _A + _B
            least = np.minimum(least, hashed.min(axis=0))
        grouped = _mix(least).reshape(2 * COLLECTION, ROWS)
        keys = np.arange(1, 2 * COLLECTION + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = _mix(keys * _P1 + grouped[:, r])
    return keys.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            sets = shingle_sets(part["text"].to_pylist())
            with np.errstate(over="ignore"):
                s1 = [int(x.sum(dtype=np.uint64).view(np.int64)) for x in sets]
                s2 = [int(np.bitwise_xor.reduce(_mix(x)).view(np.int64)) if len(x) else 0 for x in sets]
            keys = [half_keys(x) if len(x) else None for x in sets]
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                {
                    "doc_id": part["doc_id"],
                    "n_shingles": pa.array([len(x) for x in sets], pa.int64()),
                    "s1": pa.array(s1, pa.int64()),
                    "s2": pa.array(s2, pa.int64()),
                    "left": pa.array([None if k is None else k[:COLLECTION] for k in keys], longs),
                    "right": pa.array([None if k is None else k[COLLECTION:] for k in keys], longs),
                }
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1000):
            part = batch.slice(begin, 1000)
            sets = [x.view(np.int64) for x in shingle_sets(part["text"].to_pylist())]
            yield pa.record_batch({"id": part["doc_id"], "set": pa.array(sets, pa.list_(pa.int64()))})


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, linked = [], []
        for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
            x, y = x.values.to_numpy(), y.values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            common.append(both)
            linked.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        columns = [batch["a"], batch["b"], pa.array(common, pa.int64()), pa.array(linked, pa.bool_())]
        yield pa.record_batch(columns, names=["a", "b", "both", "linked"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_compare``, with the sizes of the sets, a mark of b's set and what only one of them has."""
    for batch in batches:
        for compared in _compare(iter([batch])):
            sizes, marks, apart = [], [], []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                sizes.append((len(x), len(y)))
                marks.append(int(y.sum()))
                apart.append(np.setxor1d(x, y, assume_unique=True))
            more = {
                "n_a": pa.array([n for n, _ in sizes], pa.int64()),
                "n_b": pa.array([n for _, n in sizes], pa.int64()),
                "mark": pa.array(marks, pa.int64()),
                "apart": pa.array(apart, pa.list_(pa.int64())),
            }
            yield pa.record_batch([*compared.columns, *more.values()], names=[*compared.schema.names, *more])


_COMPARED = "a long, b long, both long, linked boolean"


def _compared(pairs: DataFrame, sets: DataFrame, differ: bool = False) -> DataFrame:
    """Pairs (a, b) of documents with the size of their intersection, and whether they are linked.

    With ``differ`` pairs name nearly all sets; otherwise few, and only those are shuffled.
    """
    if not differ:
        pairs = materialize(pairs, "pairs")
        sets = among(sets, "id", pairs.select(F.explode(F.array("a", "b"))), "paired")
    theirs = [sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in ("a", "b")]
    beside = pairs.join(theirs[0], "a").join(theirs[1], "b").select("a", "b", "set_a", "set_b")
    more = ", n_a long, n_b long, mark long, apart array<long>"
    return materialize(
        beside.mapInArrow(_differ, _COMPARED + more) if differ else beside.mapInArrow(_compare, _COMPARED), "compared"
    )


def _links(compared: DataFrame) -> DataFrame:
    return compared.filter("linked").select("a", "b")


def _pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Each member of a bucket beside its centre, if their sizes allow a link."""
    near = 100 * F.least("n", "cn") >= PERCENT * F.greatest("n", "cn")
    return (
        members.join(centres, "key")
        .filter((F.col("id") != F.col("c")) & near)
        .select(F.greatest("id", "c").alias("a"), F.least("id", "c").alias("b"))
        .distinct()
    )


def _buckets(nodes: DataFrame) -> DataFrame:
    """``key``, ``id`` and ``n`` of documents that share a table key; equal buckets appear once.

    A table key can only be shared if both its halves are, so the half keys, which are few, are
    counted first, and documents combine those that others have too.
    """
    halves = nodes.select("id", F.explode("left").alias("half"), F.lit(True).alias("is_left")).unionAll(
        nodes.select("id", F.explode("right").alias("half"), F.lit(False).alias("is_left"))
    )
    common = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    left, right = F.when(F.col("is_left"), F.col("half")), F.when(~F.col("is_left"), F.col("half"))
    usable = materialize(
        halves.join(common, "half", "left_semi")
        .groupBy("id")
        .agg(F.collect_set(left).alias("left"), F.collect_set(right).alias("right")),  # 12 each at most
        "halves",
    )
    keys = usable.select("id", F.explode("left").alias("l"), "right").select(
        "id", "l", F.explode("right").alias("r")
    )
    keys = keys.select("id", F.xxhash64("l", "r").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    found = materialize(keys.join(shared, "key", "left_semi"), "found")
    equal = found.groupBy("key").agg(
        F.count("*").alias("size"),
        F.min("id").alias("least"),
        F.max("id").alias("most"),
        F.bit_xor(F.xxhash64("id")).alias("mark"),
    )
    once = equal.filter("least < most").groupBy("size", "least", "most", "mark").agg(F.min("key").alias("key"))
    members = found.join(once.select("key"), "key", "left_semi")
    return materialize(members.join(nodes.select("id", "n"), "id"), "members")


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold several components, with ``root`` and its ``weight``."""
    roots = components(links).withColumnRenamed("node", "id")
    sizes = roots.groupBy("root").agg(F.count("*").alias("weight"))
    named = members.join(roots.join(sizes, "root"), "id", "left")
    named = named.withColumn("root", F.coalesce("root", "id")).withColumn("weight", F.coalesce("weight", F.lit(0)))
    mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    return materialize(named.join(mixed.select("key"), "key", "left_semi"), "mixed")


def _rest(left: DataFrame, first: DataFrame, compared: DataFrame) -> DataFrame:
    """Candidates among members of different components: all pairs that the first comparison leaves open.

    Two documents x and y of a bucket have both been compared with its first member c. With O the
    number of shingles that stand in x or c but not both, and in y or c but not both, they share
    |x & c| + |y & c| - |c| + O. So they are linked if and only if ``(100 + PERCENT) * O`` reaches
    ``lack(x) + lack(y) - (100 - PERCENT) * |c|``, where ``lack(x)`` is
    ``100 * |c| + PERCENT * |x| - (100 + PERCENT) * |x & c|``; x is linked to c itself if its lack is
    at most ``(100 - PERCENT) * |c|``. Of two components at most one is linked to c, so O is above 0.

    Documents therefore meet by what sets them apart from c, the rarest first: if ``room`` such
    shingles are left, counting the one they meet at, O is at most the smaller room, unless they
    have met before. What members of a large group of near copies share stands in c and meets nothing.
    """
    own, theirs = F.struct("weight", "root"), F.struct("o_weight", "o_root")
    seats = left.join(first.select("key", "c"), "key").filter("id <> c").select("id", "c", "weight", "root").distinct()
    tops = seats.groupBy("c").agg(F.min(own).alias("low"), F.max(own).alias("top")).filter("low < top")
    seats = seats.join(tops, "c").select("id", "c", "weight", "root", (own < F.col("top")).alias("seeks"))
    lack = 100 * F.col("n_b") + PERCENT * F.col("n_a") - (100 + PERCENT) * F.col("both")
    apart = compared.select(
        F.col("a").alias("id"), F.col("b").alias("c"), F.col("n_a").alias("n"), lack.alias("lack"),
        ((100 - PERCENT) * F.col("n_b")).alias("slack"), F.xxhash64("b", "mark").alias("centre"),
        F.xxhash64("a", "b", "mark", "apart").alias("seat"), "apart",
    )
    apart = materialize(apart.join(seats, ["id", "c"]).dropDuplicates(["seat"]), "apart")
    beyond = apart.select("centre", "seat", F.explode("apart").alias("shingle"))
    common = beyond.groupBy("centre", "shingle").agg(F.count("*").alias("df")).filter("df > 1")
    rarest_last = Window.partitionBy("seat").orderBy(F.desc("df"), F.desc("shingle"))  # shingles of one document
    placed = beyond.join(common, ["centre", "shingle"]).withColumn("room", F.row_number().over(rarest_last))
    # Those linked to c look for others that are not, which lack more than ``slack``.
    least = F.when(F.col("lack") <= F.col("slack"), F.col("lack") + 1).otherwise(F.col("lack") - F.col("slack"))
    placed = placed.join(apart.drop("apart", "centre"), "seat").filter((100 + PERCENT) * F.col("room") >= least)
    placed = materialize(placed.select("centre", "shingle", "room", "id", "n", "lack", "slack", "weight", "root", "seeks"), "placed")
    others = [F.col(x).alias(f"o_{x}") for x in ("room", "id", "n", "lack", "weight", "root")]
    fits = (100 + PERCENT) * F.least("room", "o_room") >= F.col("lack") + F.col("o_lack") - F.col("slack")
    fits &= 100 * F.least("n", "o_n") >= PERCENT * F.greatest("n", "o_n")
    met = placed.filter("seeks").join(placed.select("centre", "shingle", *others), ["centre", "shingle"])
    met = met.filter(fits & (own < theirs.cast("struct<weight:bigint,root:bigint>")))
    return met.select(F.greatest("id", "o_id").alias("a"), F.least("id", "o_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    bound_batches(docs.sparkSession)
    signed = materialize(
        docs.select("doc_id", "text").mapInArrow(
            _signatures, "doc_id long, n_shingles long, s1 long, s2 long, left array<long>, right array<long>"
        ),
        "signatures",
    )
    some = signed.filter("n_shingles > 0")
    classes = some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"))
    nodes = materialize(
        classes.join(
            some.select(F.col("doc_id").alias("id"), "s1", "s2", "n_shingles", "left", "right"),
            ["id", "s1", "s2", "n_shingles"],
        )
        .dropDuplicates(["id", "s1"])
        .select("id", F.col("n_shingles").alias("n"), "s1", "s2", "left", "right"),
        "classes",
    )
    members = _buckets(nodes)
    wanted = among(docs.select("doc_id", "text"), "doc_id", members.select("id"), "wanted")
    sets = materialize(wanted.mapInArrow(_full_sets, "id long, set array<long>"), "sets")
    first = members.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"))
    first = first.select("key", F.col("c.id").alias("c"), F.col("c.n").alias("cn"))
    met = members.join(first.select("key", "c"), "key").filter("id <> c")
    met = met.select(F.col("id").alias("a"), F.col("c").alias("b")).distinct()
    compared = _compared(met, sets, differ=True)
    left = _labelled(members, _links(compared))
    degrees = (
        _links(compared).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    )
    ranked = left.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    second = ranked.groupBy("key").agg(F.max(F.struct("degree", "id", "n", "root")).alias("c"))
    second = second.select("key", F.col("c.id").alias("c"), F.col("c.n").alias("cn"), F.col("c.root").alias("cr"))
    tried = _pairs(left.join(second.select("key", "cr"), "key").filter("root <> cr"), second.drop("cr"))
    links = _links(compared).unionAll(_links(_compared(tried, sets)))
    left = _labelled(left.drop("root", "weight"), links)
    links = links.unionAll(_links(_compared(_rest(left, first, compared), sets)))
    roots = components(links).withColumnRenamed("node", "id")
    named = classes.join(roots, "id", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("root", "id").alias("component_id")
    )
    own = F.coalesce("component_id", "doc_id")
    return (
        signed.select("doc_id", "n_shingles", "s1", "s2")
        .join(named, ["s1", "s2", "n_shingles"], "left")
        .select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns: the one with the smallest id."""
    gone = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = if_small(gone, "near-duplicates")
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
