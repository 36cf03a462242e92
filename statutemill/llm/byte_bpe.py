"""Byte-level BPE ids of whole texts, as the tokenizers library gives them for a tokenizer.json file."""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces of nothing but white space, or without any, that are longer go to the library with a merge heap, whose time does not grow with the square of a piece's length.
LONG_PIECE = 2000


def _byte_of() -> dict[str, int]:
    """The characters that byte-level vocabularies use for bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Texts without special tokens and very long pieces take tiktoken over the same vocabulary, which is five times as fast; others take the library itself."""

    #: Fixed: how byte-level BPE of this kind splits texts.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        known = {t["content"] for t in spec["added_tokens"]}
        to_byte = _byte_of()
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in known}
        self.fast = tiktoken.Encoding("ids", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.long_space = re.compile(rf"\s{{{LONG_PIECE}}}")

    def _has_long_piece(self, text: str) -> bool:
        if len(text) < LONG_PIECE:
            return False
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) >= LONG_PIECE or len(text) - sum(sizes) >= LONG_PIECE and self.long_space.search(text) is not None

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if any(s in text for s in self.special) or self._has_long_piece(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder a process and file."""
    return ByteBPE(path)
