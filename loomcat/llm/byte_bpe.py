"""Byte-level BPE ids and the bytes of tokens, for vocabularies in which every rank is an id."""

from __future__ import annotations

import json
import re

import tiktoken
from tokenizers import Tokenizer

from loomcat.llm.bpe import SPLIT
from loomcat.llm.word_bpe import byte_symbols

#: Texts with other characters are encoded by the library itself, since Unicode versions may differ.
_ODD = re.compile("[^\t\n\x0b\x0c\r -~\xa1-ɏ]")


def vocabulary(definition: str) -> dict[bytes, int]:
    """Bytes of every ordinary token of a byte-level tokenizer, and its id."""
    value = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
    return {bytes(map(value.__getitem__, s)): i for s, i in json.loads(definition)["model"]["vocab"].items()}


class ByteBpe:
    """Encodes as the ``tokenizers`` library does, several times as fast."""

    def __init__(self, definition: str, special: bool = True) -> None:
        kind = json.loads(definition)
        before, merges = kind["pre_tokenizer"] or {}, kind["model"]["merges"]
        plain = not kind["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        ranks = vocabulary(definition)
        first = len(ranks) - len(merges)
        joined = ("".join(m.split(" ") if isinstance(m, str) else m) for m in merges)
        vocab = kind["model"]["vocab"]
        if not plain or before.get("add_prefix_space") or any(vocab[m] != first + i for i, m in enumerate(joined)):
            raise ValueError("only byte-level tokenizers with the usual split and ranks as ids are supported")
        names = {a["content"]: a["id"] for a in kind["added_tokens"]} if special else {}
        self._allowed = set(names)
        self._quick = tiktoken.Encoding("byte", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=names)
        self._library = Tokenizer.from_str(definition)
        self._library.no_truncation()
        self._library.no_padding()
        self._library.encode_special_tokens = not special

    def encode(self, text: str) -> list[int]:
        if _ODD.search(text):
            return self._library.encode(text, add_special_tokens=False).ids
        if self._allowed:
            return self._quick.encode(text, allowed_special=self._allowed, disallowed_special=())
        return self._quick.encode_ordinary(text)
