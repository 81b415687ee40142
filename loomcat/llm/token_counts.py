"""Token counts from pre-token frequencies.

The corpus is counted by pre-token; each distinct pre-token is encoded once, and its number of
pieces meets the documents' pre-token frequencies in a join, where the products are summed. The
commonest pre-tokens, at most ``FREQUENT`` of at most ``SHORT`` bytes, are joined where the texts are
read, so that a document sends one sum for them; all other pre-tokens go through a shuffled join. How
common they are is read off a histogram of counts, so only they reach the driver. No short pre-token is
hot in the join, because the hot ones are among the commonest; a long one takes many bytes of every
text it stands in, and its rows are split as a skewed join. Ids are never kept.

A row is known by its id, a 64-bit hash of its text, and its bytes. NULL texts count as empty, rows with a NULL id stay;
repeated rows each get a row; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.llm.bpe import PreTokens
from loomcat.llm.common import bound_batches
from loomcat.session import materialize

FREQUENT = 1 << 17
SHORT = 256  # bytes; with FREQUENT, 32 MB in the driver and in each worker at most
LIMIT = 512


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, because a text takes far more room once it is split."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", F.xxhash64(text).alias("print"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    pieces = _pieces(rows.select("text"), definition)
    common = spark.sparkContext.broadcast(
        {r["piece"]: r["size"] for r in _commonest(pieces).select("piece", "size").collect()}
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, sizes = PreTokens(definition.value).split, common.value
        for batch in _parts(batches):
            ids, names, times = [], [], []
            at = 0
            bases = []
            for value in batch["text"].to_pylist():
                known = 0
                for piece, n in Counter(split(value)).items():
                    size = sizes.get(piece)
                    if size is None:
                        names.append(piece)
                        times.append(n)
                        ids.append(at)
                    else:
                        known += size * n
                bases.append(known)
                at += 1
            rest = len(names)
            # One row for the document itself; its key equals no pre-token and is spread over tasks.
            names.extend(f"\0{mark}:{i}" for i, mark in enumerate(batch["print"].to_pylist()))
            times.extend([0] * at)
            take = pa.array(ids + list(range(at)), pa.int64())
            sums = pa.array([0] * rest + bases, pa.int64())
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(take),
                    "print": batch["print"].take(take),
                    "n_bytes": batch["n_bytes"].take(take),
                    "base": pa.array([0] * rest + [1] * at, pa.int64()),
                    "piece": pa.array(names, pa.string()),
                    "times": pa.array(times, pa.int64()),
                    "known": sums,
                }
            )

    found = rows.mapInArrow(
        frequencies,
        "doc_id long, print long, n_bytes long, base long, piece string, times long, known long",
    )
    tokens = F.col("known") + F.col("times") * F.coalesce(F.col("size"), F.lit(0))
    return (
        found.join(pieces.select("piece", "size"), "piece", "left")
        .groupBy("doc_id", "print", "n_bytes")
        .agg(F.sum(tokens).alias("all"), F.sum("base").alias("copies"))
        .select(
            "doc_id",
            "n_bytes",
            (F.col("all") / F.col("copies")).cast("long").alias("n_tokens"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _commonest(pieces: DataFrame) -> DataFrame:
    """The short pre-tokens of the highest counts, as many whole classes of counts as fit ``FREQUENT``.

    A class holds counts within a ninth of each other, so there are a few hundred. One that does not fit
    any more holds so many pre-tokens that none of them is hot.
    """
    short = pieces.filter(F.octet_length("piece") <= SHORT)
    of = F.floor(8 * F.log2(F.col("n").cast("double"))).cast("int")
    sizes = short.groupBy(of.alias("class")).agg(F.count("*").alias("pieces")).collect()
    least, total = None, 0
    for row in sorted(sizes, reverse=True):
        total += row["pieces"]
        if total > FREQUENT:
            break
        least = row["class"]
    return short.filter(of >= least) if least is not None else short.limit(0)


def _pieces(texts: DataFrame, definition) -> DataFrame:
    """Every distinct pre-token, how often it occurs, and its number of pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = PreTokens(definition.value).split
        for batch in _parts(batches, 2000):
            found: Counter[str] = Counter()
            for value in batch["text"].to_pylist():
                found.update(split(value))
            yield pa.record_batch({"piece": pa.array(found, pa.string()), "n": pa.array(found.values(), pa.int64())})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(definition.value)
        for batch in batches:
            sizes = tokens.counts(batch["piece"].to_pylist())
            yield pa.record_batch({"piece": batch["piece"], "n": batch["n"], "size": pa.array(sizes, pa.int32())})

    counted = texts.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return materialize(counted.mapInArrow(measure, "piece string, n long, size int"), "pieces")
