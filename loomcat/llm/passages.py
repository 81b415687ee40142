"""Repeated passages by collinear chaining of shared k-mers.

Of each text's k-mers of ``K`` words, those that are smallest in a window of ``WINDOW`` are its seeds
(two texts that share 19 words in a row share a seed). Seeds meet in a join, each occurrence only
with the first one of the corpus, so that a passage in a thousand documents gives a thousand links.
The links of each pair of documents are chained in order in both: a Fenwick tree over the places in
the second text keeps the best chain so far, and skipped words cost ``GAP`` each. The words under
each chain, extended at both ends, are aligned in a band; passages of ``MIN_WORDS`` words or more with
80 per cent equal words are reported. Whole copies are folded first and reported against the first.

Words are lower-case and separated by white space. NULL and short texts have no passages; rows with
one id are one document; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.llm.common import bound_batches
from loomcat.llm.near_dedup import _P1, _mix, word_hashes
from loomcat.session import materialize

K = 8
WINDOW = 12
GAP = 0.02
MIN_WORDS = 50
PERCENT = 80
BAND = 12  # words by which aligned texts may be out of step
REACH = 100  # words looked at beyond a chain's ends, where seeds met in other documents


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the selected k-mers."""
    n = len(words) - K + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    with np.errstate(over="ignore"):
        hashed = np.zeros(n, np.uint64)
        for i in range(K):
            hashed = hashed * _P1 + words[i : i + n]
        hashed = _mix(hashed)
    size = min(WINDOW, n)
    windows = np.lib.stride_tricks.sliding_window_view(hashed, size)
    at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return hashed[at].view(np.int64), at.astype(np.int32)


def chains(links: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """First and last places (ours, ours, theirs, theirs) of disjoint chains, best first."""
    links = sorted(set(links))
    rank = {q: r for r, q in enumerate(sorted({q for _, q in links}), 1)}
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(rank) + 1)
    score, before = [0.0] * len(links), [-1] * len(links)
    done = 0
    for i, (p, q) in enumerate(links):
        while links[done][0] < p:  # links at one place do not follow each other
            _raise(tree, rank[links[done][1]], (score[done] + GAP * sum(links[done]), done))
            done += 1
        best, r = (0.0, -1), rank[q] - 1
        while r > 0:
            best = max(best, tree[r])
            r -= r & -r
        gained = best[0] - GAP * (p + q) if best[1] >= 0 else 0.0
        if gained > 0:
            p0, q0 = links[best[1]]
            score[i], before[i] = gained + min(K, p - p0, q - q0), best[1]
        else:
            score[i] = K
    used = [False] * len(links)
    found = []
    for end in sorted(range(len(links)), key=lambda i: -score[i]):
        if used[end]:
            continue
        i = first = end
        while i >= 0 and not used[i]:
            used[i], first = True, i
            i = before[i]
        found.append((links[first][0], links[end][0], links[first][1], links[end][1]))
    return found


def _raise(tree: list[tuple[float, int]], r: int, value: tuple[float, int]) -> None:
    while r < len(tree):
        tree[r] = max(tree[r], value)
        r += r & -r


def align(a: np.ndarray, b: np.ndarray, core: int) -> list[tuple[int, int]]:
    """Places of equal words, in order in both, from the start on.

    Runs of equal words are taken whole. Between them, the nearest place in a band at which two words
    in a row agree again is looked for; where there is none, the alignment ends, unless it is still
    among the first ``core`` words.
    """
    out: list[tuple[int, int]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        run = min(len(a) - i, len(b) - j)
        same, size = 0, 64
        while same < run:
            upto = min(run, same + size)
            differ = np.flatnonzero(a[i + same : i + upto] != b[j + same : j + upto])
            if len(differ):
                same += int(differ[0])
                break
            same, size = upto, size * 4
        out.extend(zip(range(i, i + same), range(j, j + same), strict=True))
        i, j = i + same, j + same
        x, y = a[i : i + BAND + 2], b[j : j + BAND + 2]
        if len(x) < 2 or len(y) < 2:
            break
        equal = x[:, None] == y[None, :]
        places = np.argwhere(equal[:-1, :-1] & equal[1:, 1:])
        if len(places):
            step = places[places.max(axis=1).argmin()]
            i, j = i + int(step[0]), j + int(step[1])
        elif i < core:
            i, j = i + 1, j + 1
        else:
            break
    return out


def passage(a: np.ndarray, b: np.ndarray, first: int, last: int) -> tuple[int, int, int, int, int] | None:
    """The stretch of two slices in which most words are equal: its ends and their number.

    The chain starts at ``first`` in both and ends before ``last`` in ours; the words before it are
    aligned backwards from there.
    Equal words count what the threshold leaves over and others what it asks for, so that every
    stretch with a positive sum has enough equal words; the largest sum wins.
    """
    back = align(a[:first][::-1], b[:first][::-1], 0)
    pairs = [(first - 1 - i, first - 1 - j) for i, j in back[::-1]]
    pairs += [(first + i, first + j) for i, j in align(a[first:], b[first:], last - first)]
    best, total, begin = (0, 0, 0), 0, 0
    for n, (i, j) in enumerate(pairs):
        if n:
            total -= PERCENT * (max(i - pairs[n - 1][0], j - pairs[n - 1][1]) - 1)
        if total <= 0:
            total, begin = 0, n
        total += 100 - PERCENT
        best = max(best, (total, -begin, n))
    if not best[0]:
        return None
    (i0, j0), (i1, j1) = pairs[-best[1]], pairs[best[2]]
    if min(i1 - i0, j1 - j0) + 1 < MIN_WORDS:
        return None
    return i0, i1 + 1, j0, j1 + 1, best[2] + best[1] + 1


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        h, bounds = _words(part["text"])
        found = [seeds(h[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        counts = [len(k) for k, _ in found]
        yield pa.record_batch(
            {
                "id": part["id"].take(pa.array(np.repeat(np.arange(len(found)), counts))),
                "key": pa.array(np.concatenate([k for k, _ in found]), pa.int64()),
                "at": pa.array(np.concatenate([p for _, p in found]), pa.int32()),
            }
        )


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 500):
            yield batch.slice(begin, 500)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([(t or "").lower() for t in texts.to_pylist()])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        h, bounds = _words(part["text"])
        short = (h >> np.uint64(33)).astype(np.int32)
        rows = [short[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch({"id": part["id"], "words": pa.array(rows, pa.list_(pa.int32()))})


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, others, found = [], [], []
        for id_, other, links in zip(*(batch[c].to_pylist() for c in ("id", "other", "links")), strict=True):
            for chain in chains([(x["at"], x["there"]) for x in links]):
                ids.append(id_)
                others.append(other)
                found.append(chain)
        columns = list(zip(*found, strict=True)) or [[]] * 4
        names = ["first", "last", "their_first", "their_last"]
        yield pa.record_batch(
            {"id": pa.array(ids, pa.int64()), "other": pa.array(others, pa.int64())}
            | {n: pa.array(c, pa.int32()) for n, c in zip(names, columns, strict=True)}
        )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.int64()
    names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "n_equal"]
    for batch in batches:
        rows = []
        columns = ("id", "begin", "other", "their_begin", "first", "last")
        for n, (id_, begin, other, there, first, last) in enumerate(zip(*(batch[c].to_pylist() for c in columns), strict=True)):
            ours, theirs = batch["ours"][n].values.to_numpy(), batch["theirs"][n].values.to_numpy()
            if found := passage(ours, theirs, first - begin, last + K - begin):
                i0, i1, j0, j1, equal = found
                rows.append((id_, begin + i0, begin + i1, other, there + j0, there + j1, equal))
        values = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.record_batch([pa.array(v, kind) for v in values], names=names)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages (word places, end exclusive) that stand in an earlier document too.

    A row may overlap with another of the same pair, if the passage occurs more than once in it.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").alias("id"), "text").filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    same = ["h1", "h2", "size"]
    marks = materialize(
        texts.select(
            "id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"),
            F.octet_length("text").alias("size"),
            F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("n"),
        ),
        "marks",
    )
    firsts = marks.groupBy(*same).agg(F.min("id").alias("first"), F.max("id").alias("final")).filter("first < final")
    copies = marks.join(firsts.select(*same, "first"), same).filter(F.col("id") != F.col("first"))
    copies = materialize(copies.select("id", "first", "n"), "copies")
    single = texts.join(copies.select("id"), "id", "left_anti")
    found = materialize(single.mapInArrow(_seed_rows, "id long, key long, at int"), "seeds")
    shared = found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    again = materialize(found.join(shared, "key", "left_semi"), "shared-seeds")
    first = again.groupBy("key").agg(F.min(F.struct("id", "at")).alias("c"))
    links = again.join(first, "key").filter(F.col("id") != F.col("c.id"))
    pairs = links.groupBy("id", F.col("c.id").alias("other")).agg(
        F.collect_list(F.struct("at", F.col("c.at").alias("there"))).alias("links")  # of one document
    )
    chained = materialize(
        pairs.mapInArrow(
            _chain_rows, "id long, other long, first int, last int, their_first int, their_last int"
        ),
        "chains",
    )
    wanted = chained.select("id").unionAll(chained.select("other")).distinct()
    words = materialize(
        texts.join(wanted, "id", "left_semi").mapInArrow(_word_rows, "id long, words array<int>"), "words"
    )
    before = F.least(F.lit(REACH), F.col("first"), F.col("their_first"))
    candidates = chained.withColumns(
        {"begin": F.col("first") - before, "their_begin": F.col("their_first") - before}
    )
    ours = F.slice("words", F.col("begin") + 1, F.col("last") + K + REACH - F.col("begin")).alias("ours")
    theirs = F.slice("words", F.col("their_begin") + 1, F.col("their_last") + K + REACH - F.col("their_begin"))
    sliced = (
        candidates.join(words, "id")
        .select("id", "begin", "other", "their_begin", "their_last", "first", "last", ours)
        .join(words.select(F.col("id").alias("other"), "words"), "other")
        .select("id", "begin", "other", "their_begin", "first", "last", "ours", theirs.alias("theirs"))
    )
    out = "doc_id long, start long, end long, other_id long, other_start long, other_end long, n_equal long"
    whole = copies.filter(F.col("n") >= MIN_WORDS).select(
        F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"),
        F.col("first").alias("other_id"), F.lit(0).cast("long").alias("other_start"), F.col("n").alias("other_end"),
        F.col("n").alias("n_equal"),
    )
    return sliced.mapInArrow(_passages, out).distinct().unionAll(whole)
