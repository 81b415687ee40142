"""Byte-level BPE with a cache of pre-tokens, for files of the ``tokenizers`` library."""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from tokenizers import Tokenizer

# Fixed value: the pattern by which the byte-level pre-tokenizer splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts with other characters are split by the library, since Unicode versions may differ.
_ODD = re.compile("[^\t\n\x0b\x0c\r -~\xa1-ɏ]")
CACHED = 300_000  # pre-tokens; about 60 MB in a worker


class PreTokens(dict):
    """Splits texts into pre-tokens and special strings; maps each to its ids, encoding it once."""

    def __init__(self, definition: str) -> None:
        kind = json.loads(definition)
        before = kind["pre_tokenizer"] or {}
        plain = not kind["normalizer"] and before.get("type") == "ByteLevel"
        if not (plain and before.get("use_regex", True)) or before.get("add_prefix_space"):
            raise ValueError("only byte-level tokenizers with the usual split are supported")
        self._library = Tokenizer.from_str(definition)
        self._library.no_truncation()
        self._library.no_padding()
        self._find = regex.compile(SPLIT).findall
        added = sorted((a["content"] for a in kind["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def split(self, text: str) -> list[str]:
        if self._special is not None and self._special.search(text):
            out: list[str] = []
            for n, part in enumerate(self._special.split(text)):
                out.extend([part] if n % 2 else self._split(part))
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if _ODD.search(text):
            pieces = self._library.pre_tokenizer.pre_tokenize_str(text)
            spans = [span for _, span in pieces]
            if not _tiles(spans, len(text)):
                raise ValueError("the library's pre-tokens do not make up the text")
            return [text[a:b] for a, b in spans]
        return self._find(text)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if len(self) > CACHED:
            self.clear()
        return b"".join(map(self.__getitem__, self.split(text)))

    def __missing__(self, piece: str) -> bytes:
        ids = self._library.encode(piece, add_special_tokens=False).ids
        self[piece] = found = np.array(ids, "<u4").tobytes()
        return found

    def counts(self, pieces: list[str]) -> list[int]:
        """Number of ids of each pre-token, on the task's own thread and without keeping the ids."""
        return [len(self._library.encode(x, add_special_tokens=False)) for x in pieces]


def _tiles(spans: list[tuple[int, int]], size: int) -> bool:
    ends = [0, *[b for _, b in spans]]
    return all(a == e for (a, _), e in zip(spans, ends, strict=False)) and ends[-1] == size
