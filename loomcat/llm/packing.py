"""Packing of token sequences by best fit, improved by swaps.

Documents are encoded where they are read; only places and lengths are packed. Pieces that fill a
sequence stand alone. The others are dealt by hash into shares of at most about ``SHARE`` pieces,
each packed in one task: longest first into the fullest sequence that takes it, then local search
between underfull sequences. A step moves a piece, or exchanges one or two of another sequence for
one longer piece of the emptier one, so that the sum of squared fills grows, until sequences empty
out or the total length shows that no fewer are possible. What stays underfull in each share is dealt
and packed once more together.

A document longer than a sequence is cut from its end, so that its first piece may be shorter. NULL
texts count as empty and still hold the closing id; repeated rows are packed each; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomcat.llm.byte_bpe import ByteBpe
from loomcat.llm.common import bound_batches
from loomcat.session import materialize

CAPACITY = 2048
CLOSING = 0  # the id after each document
SHARE = 40_000
#: A share hands on sequences with more free places than this.
SLACK = 8
TRIES = 400  # failed attempts to empty a sequence before a share is left as it is
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encode(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    bound_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteBpe(definition.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = memoryview(np.array([*tokens.encode(text or ""), CLOSING], "<u4").tobytes())
                size = len(ids) // 4
                begin, end, n = 0, (size - 1) % capacity + 1, 0
                while begin < size:
                    rows.append((doc_id, n, begin, end - begin, zlib.crc32(ids[4 * begin : 4 * end])))
                    begin, end, n = end, end + capacity, n + 1
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = [c.split()[0] for c in _PIECE.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(pieces, _PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences of item numbers: longest first, into the fullest sequence that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[chosen].append(item)
        else:
            room, chosen = capacity, len(bins)
            bins.append([item])
        if room > size:
            by_room[room - size].append(chosen)
            rooms |= 1 << (room - size)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, tries: int = TRIES) -> list[list[int]]:
    """Empties sequences by moves and by one- and two-for-one exchanges that raise the squared fill."""
    fewest = -(-int(lengths.sum()) // capacity)
    full = [b for b in bins if lengths[b].sum() == capacity]
    open_bins = [b for b in bins if lengths[b].sum() < capacity]
    stuck: list[list[int]] = []
    while len(full) + len(open_bins) + len(stuck) > fewest and tries > 0 and len(open_bins) > 1:
        fills = np.array([lengths[b].sum() for b in open_bins])
        donor = int(fills.argmin())
        emptied, changed = _drain(open_bins, fills, donor, lengths, capacity)
        if emptied:
            open_bins.pop(donor)
        elif not changed:
            # Nothing improves this one until another sequence has changed.
            stuck.append(open_bins.pop(donor))
            tries -= 1
        if changed:
            open_bins, stuck = open_bins + stuck, []
        full += [b for b in open_bins if lengths[b].sum() == capacity]
        open_bins = [b for b in open_bins if lengths[b].sum() < capacity]
    return full + open_bins + stuck


def _drain(
    bins: list[list[int]], fills: np.ndarray, donor: int, lengths: np.ndarray, capacity: int
) -> tuple[bool, bool]:
    """One pass over the donor's items, longest first; whether it emptied, and whether it changed."""
    owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    items = np.concatenate(bins)
    ones = (owner, items, np.full(len(items), -1), lengths[items])
    pairs = [(o, a, b) for o, held in enumerate(bins) if o != donor for i, a in enumerate(held) for b in held[:i]]
    twos = None
    if pairs:
        o, a, b = np.array(pairs).T
        twos = (o, a, b, lengths[a] + lengths[b])
    stale = np.zeros(len(bins), bool)
    stale[donor] = True
    changed = False
    for item in sorted(bins[donor], key=lambda i: -lengths[i]):
        size = int(lengths[item])
        room = capacity - fills
        usable = ~stale & (fills + 0 >= fills[donor] - size)
        fits = np.flatnonzero(usable & (room >= size))
        if len(fits):
            target = int(fits[room[fits].argmin()])
            bins[donor].remove(item)
            bins[target].append(item)
            out = 0
        else:
            best = None
            for owners, first, second, total in [ones] + ([twos] if twos else []):
                gain = size - total
                possible = np.flatnonzero(usable[owners] & (gain > 0) & (gain <= room[owners]))
                possible = possible[fills[owners[possible]] + gain[possible] > fills[donor]]
                if len(possible):
                    pick = int(possible[gain[possible].argmax()])
                    if best is None or gain[pick] > best[0]:
                        best = (int(gain[pick]), int(owners[pick]), int(first[pick]), int(second[pick]))
            if best is None:
                continue
            _, target, one, two = best
            back = [one] if two < 0 else [one, two]
            bins[donor].remove(item)
            bins[donor].extend(back)
            bins[target] = [x for x in bins[target] if x not in back] + [item]
            out = int(lengths[back].sum())
        fills[donor] += out - size
        fills[target] += size - out
        stale[target] = True  # its items are no longer those listed
        changed = True
    return not bins[donor], changed


def _packed(rows: DataFrame, capacity: int, level: int, share: int) -> DataFrame:
    """Each share packed in a task of its own: pieces with sequence, offset and the sequence's fill."""
    shares = max(1, -(-rows.count() // share))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = group["length"].to_numpy()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        first = (level << 60) + (int(key[0]) << 32)
        order = np.concatenate(bins)
        sizes = lengths[order]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        fill = np.bincount(number, sizes).astype("int64")
        out = group.iloc[order].drop(columns="share")
        before = np.cumsum(sizes) - sizes
        starts = np.cumsum(fill) - fill
        return out.assign(sequence_id=first + number, offset=before - starts[number], fill=fill[number])

    key = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(shares)).alias("share")
    return rows.select("*", key).groupBy("share").applyInPandas(
        pack, _PIECE + ", sequence_id long, offset long, fill long"
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``."""
    pieces = materialize(encode(docs, tokenizer_path, capacity), "pieces")
    alone = pieces.filter(F.col("length") == capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id() + F.lit(3 << 60), "offset": F.lit(0).cast("long")}
    )
    first = materialize(_packed(pieces.filter(F.col("length") < capacity), capacity, 1, share), "packed")
    under = F.col("fill") < capacity - SLACK
    again = _packed(first.filter(under).drop("sequence_id", "offset", "fill"), capacity, 2, share)
    columns = [*pieces.columns, "sequence_id", "offset"]
    return (
        first.filter(~under).select(columns).unionAll(again.select(columns)).unionAll(alone.select(columns))
    )
