"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words and word stems (the first ``STEM`` letters), word pairs, and
pairs with one word between them, hashed into ``2 ** BITS`` places. Each place has a learning rate of its own and an L1 threshold, so that few
weights are not zero; only those are broadcast. Training takes at most ``SAMPLE`` labelled rows, those
with the smallest hash of their id, in one task; every text is scored.

Words are lower-case and without punctuation at their ends. NULL and empty texts score the prior;
labels without a text or with a NULL are not used, several labels of one id count as their maximum;
repeated rows score alike; an empty table gives an empty result; without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomcat.llm.common import bound_batches

BITS = 22
SAMPLE = 16_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 1.0
STEM = 4  # letters that stand for all inflections of a word
BIAS = 1 << BITS  # the place of the constant feature
FOLDS = 5
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…|"


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of all features; a feature that occurs twice in a text is there twice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    rows = np.asarray(pc.list_parent_indices(split))
    words = pc.utf8_trim(pc.list_flatten(split), _EDGES)
    real = np.asarray(pc.not_equal(words, ""), bool)
    h = _hashes(words)[real]
    stems = _hashes(pc.utf8_slice_codeunits(words, 0, STEM))[real]
    rows = rows[real]
    found = [(rows, _place(h, 1) >> 1), (rows, _place(stems, 4) >> 1)]
    for gap in (1, 2):
        same = rows[gap:] == rows[:-gap]
        with np.errstate(over="ignore"):
            pair = h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(2 * gap + 1)
        found.append((rows[gap:][same], (_place(pair, gap + 1) >> 1)[same] + (BIAS >> 1)))
    return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash for each word, computed once for each distinct one."""
    coded = words.dictionary_encode()
    known = coded.dictionary.to_numpy(zero_copy_only=False).astype(object)
    hashed = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    return hashed[np.asarray(coded.indices, np.int64)]


def _place(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        threshold = np.where(at == BIAS, 0.0, L1)
        over = np.abs(z[at]) > threshold
        return np.where(over, -(z[at] - np.sign(z[at]) * threshold) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    examples = []
    for begin in range(0, len(texts), 1000):
        part = texts[begin : begin + 1000]
        rows, at = features(pa.array(part, pa.string()))
        order = np.argsort(rows, kind="stable")
        bounds = np.searchsorted(rows[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            own = np.unique(at[order[bounds[i] : bounds[i + 1]]]).astype(np.int32)
            examples.append(np.append(own, np.int32(BIAS)))
    turn = np.random.default_rng(7)
    for _ in range(epochs):
        for i in turn.permutation(len(examples)):
            at = examples[i]
            w = weights(at)
            error = _sigmoid(w.sum()) - labels[i]
            squared = error * error
            step = (np.sqrt(n[at] + squared) - np.sqrt(n[at])) / ALPHA
            z[at] += error - step * w
            n[at] += squared
    used = np.flatnonzero((np.abs(z) > L1) | (np.arange(BIAS + 1) == BIAS))
    return used, weights(used)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The weights as rows of ``place`` and ``weight``."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    examples = texts.join(F.broadcast(chosen), "doc_id").select(F.lit(0).alias("all"), "doc_id", "text", "toxic")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], ignore_index=True)
        at, weight = train(group["text"].tolist(), (group["toxic"] > 0).to_numpy(float))
        return pd.DataFrame({"place": at, "weight": weight})

    return examples.groupBy("all").applyInPandas(learn, "place long, weight double")


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``doc_id`` and ``score`` of every document."""
    # Bounded by the sample and by 2 ** BITS. Ordered here: a sort in Spark samples, and so fits, first.
    rows = sorted(model.collect())
    table = docs.sparkSession.sparkContext.broadcast(
        (np.array([r["place"] for r in rows], np.int64), np.array([r["weight"] for r in rows], np.float32))
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = table.value
        dense = np.zeros(BIAS + 1, np.float32)
        dense[places] = values
        for batch in batches:
            count = batch.num_rows
            total = np.full(count, float(dense[BIAS]))
            for begin in range(0, count, 500):
                row, at = features(batch["text"].slice(begin, 500))
                telling = dense[at] != 0
                pair = np.unique(row[telling] * (BIAS + 1) + at[telling])
                row, at = pair // (BIAS + 1), pair % (BIAS + 1)
                np.add.at(total, begin + row, dense[at])
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(_sigmoid(total), pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document."""
    bound_batches(docs.sparkSession)
    return score(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
