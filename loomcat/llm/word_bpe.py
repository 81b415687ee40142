"""Encoding and decoding with byte-pair merges over words with an end mark.

A text is cut at special strings, normalised, and cut into words; each word's bytes become symbols, the
last one with the end mark. A word's parts are held as one list of boundaries and one list with the
merge rank of every two adjacent parts. The lowest rank is looked for by scanning, its boundary is
deleted, and the two neighbouring ranks are refreshed, until no adjacent parts can merge. Scanning is
the quickest way for the few symbols of a usual word, but its time grows with the square of the length;
words over ``SCANNED`` symbols keep their adjacent ranks in a heap, with the same result. Words are
encoded once for as long as a worker remembers them.

NULL texts count as empty and have no ids; rows with a NULL id stay; repeated rows each get a row; an
empty table gives an empty result; the texts' own special strings become special ids, as in the library;
further columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from loomcat.llm.common import bound_batches

SCANNED = 256  # symbols of a word up to which its ranks are scanned
REMEMBERED = 64  # bytes of a word up to which its ids are remembered
CACHED = 200_000  # words remembered; about 50 MB in a worker
_NEVER = 1 << 62

# The normalisation and the split of the tokenizers that are read without the library.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Characters that Unicode's versions treat alike; texts with others are normalised and split by the library.
_ODD = re.compile("[^\t\n\x0b\x0c\r -~\xa1-įı-ɏ]")


def _class(kind: str) -> str:
    lowered = sorted({chr(c).lower() for c in range(33, 0x250) if c != 0x130})
    return "".join(c for c in lowered if unicodedata.category(c)[0] == kind)


_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\\s{_class('L')}{_class('N')}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in visible else next(free)) for b in range(256)]


class WordBpe:
    """A byte-pair tokenizer over words, from a definition of the ``tokenizers`` library."""

    def __init__(self, definition: str) -> None:
        kind = json.loads(definition)
        model = kind["model"]
        last = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])[-1]
        plain = model["type"] == "BPE" and not any(
            model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")
        )
        simple = not any(a[x] for a in kind["added_tokens"] for x in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (plain and simple) or last.get("type") != "ByteLevel" or last.get("use_regex") or kind["decoder"]:
            raise ValueError("only byte-pair tokenizers over words, without a decoder, are supported")
        self._end = model["end_of_word_suffix"] or ""
        self._vocabulary: dict[str, int] = model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self._ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        special = {a["content"]: a["id"] for a in kind["added_tokens"]}
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._special_ids = special
        size = max([*self._vocabulary.values(), *special.values()]) + 1
        self._strings = [""] * size
        for string, number in (self._vocabulary | special).items():
            self._strings[number] = string
        normal = (kind["normalizer"] or {}).get("normalizers")
        split = kind["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex")
        self._known = normal == _NORMAL and split == _SPLIT
        self._library = Tokenizer.from_str(definition)
        self._symbols = {b: c for b, c in enumerate(byte_symbols())}
        self._cache: dict[str, list[int]] = {}

    def encode(self, text: str) -> list[int]:
        if self._special is None or not self._special.search(text):
            return list(chain.from_iterable(map(self._word, self._words(text))))
        out: list[int] = []
        for n, part in enumerate(self._special.split(text)):
            out.extend([self._special_ids[part]] if n % 2 else chain.from_iterable(map(self._word, self._words(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The ids' strings, end marks included, with one space between."""
        return " ".join(map(self._strings.__getitem__, ids))

    def _words(self, text: str) -> list[str]:
        if self._known and not _ODD.search(text):
            words = _WORD.findall(text.lower())
            return words if text.isascii() else [w if w.isascii() else self._mapped(w) for w in words]
        if self._library.normalizer is not None:
            text = self._library.normalizer.normalize_str(text)
        return [piece for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self._symbols)

    def _word(self, word: str) -> list[int]:
        ids = self._cache.get(word)
        if ids is None:
            bounds = self._parts(word + self._end, len(word))
            string = word + self._end
            ids = [self._vocabulary[string[a:b]] for a, b in zip(bounds, bounds[1:])]  # noqa: B905
            if len(word) <= REMEMBERED:
                if len(self._cache) >= CACHED:
                    self._cache.clear()
                self._cache[word] = ids
        return ids

    def _parts(self, string: str, symbols: int) -> list[int]:
        """Boundaries of the parts of a word whose first ``symbols`` places are symbols, the end mark in the last."""
        bounds = [*range(symbols), len(string)]
        if symbols > SCANNED:
            return self._merged_long(string, bounds)
        find = self._ranks.get
        ranks = [
            find((string[a:b], string[b:c]), _NEVER)
            for a, b, c in zip(bounds, bounds[1:], bounds[2:])  # noqa: B905
        ]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            del bounds[at + 1], ranks[at]
            if at:
                a, b, c = bounds[at - 1 : at + 2]
                ranks[at - 1] = find((string[a:b], string[b:c]), _NEVER)
            if at < len(ranks):
                a, b, c = bounds[at : at + 3]
                ranks[at] = find((string[a:b], string[b:c]), _NEVER)
        return bounds

    def _merged_long(self, string: str, bounds: list[int]) -> list[int]:
        """The same boundaries for a long word: adjacent ranks in a heap, parts as a linked list."""
        find = self._ranks.get
        count = len(bounds) - 1
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        ends = bounds[1:]
        alive = [True] * count
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < count:
                rank = find((string[bounds[left] : ends[left]], string[bounds[right] : ends[right]]))
                if rank is not None:
                    heapq.heappush(heap, (rank, left, ends[left], ends[right]))

        for left in range(count):
            offer(left)
        while heap:
            _, left, middle, end = heapq.heappop(heap)
            # An offer is stale when one of its two parts has grown or gone since.
            if not alive[left] or ends[left] != middle or after[left] >= count or ends[after[left]] != end:
                continue
            right = after[left]
            alive[right] = False
            ends[left], after[left] = end, after[right]
            if after[right] < count:
                before[after[right]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return [*(bounds[i] for i in range(count) if alive[i]), len(string)]


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` of every document, and on request the text that the ids decode to."""
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordBpe(definition.value)
        for batch in batches:
            yield from _encoded(tokenizer, batch, decoded)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)


_TOGETHER = 1_000_000  # ids in one batch that goes back, unless a single text has more


def _encoded(tokenizer: WordBpe, batch: pa.RecordBatch, decoded: bool) -> Iterator[pa.RecordBatch]:
    begin, lists, held = 0, [], 0
    texts = batch["text"]
    for row in range(batch.num_rows + 1):
        if row == batch.num_rows or held > _TOGETHER:
            sizes = np.cumsum([0, *map(len, lists)]).astype("int32")
            flat = pa.array(np.fromiter(chain.from_iterable(lists), "int32", int(sizes[-1])))
            columns = {
                "doc_id": batch["doc_id"].slice(begin, row - begin).cast(pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array(sizes), flat),
            }
            if decoded:
                columns["decoded"] = pa.array(map(tokenizer.decode, lists), pa.string())
            yield pa.record_batch(columns)
            begin, lists, held = row, [], 0
        if row < batch.num_rows:
            lists.append(tokenizer.encode(texts[row].as_py() or ""))
            held += len(lists[-1])
