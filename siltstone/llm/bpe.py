"""Byte-level BPE by a public tokenizer file: ids and counts per space-separated piece, with a bounded cache.

A text is cut at the single spaces that stand between two non-space characters. The pre-tokenizer always starts
a token at such a space, so every piece (with its leading space) encodes alone as it does inside the text.
"""

from __future__ import annotations

import json
import re
import struct
from array import array

import regex

#: The pre-tokenizer's pattern, its special string, and the blocks of code points
#: that `regex` counts as letters or numbers but the tokenizers library does not yet.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIAL = "<|endoftext|>"
NEWER = re.compile("[\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6]")

_CUT = re.compile(r"(?<=\S) (?=\S)")
_words = regex.compile(PATTERN)


class _Edge(Exception):
    """A piece starts or ends with white space: the text needs the slower cut."""


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_ranks(path: str) -> tuple[dict[bytes, int], int]:
    """Bytes of each token -> id, and the special token's id. Raises unless ids follow the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged) or len(set(merged)) != len(merged):
        raise ValueError("ids do not follow the merges: ranks cannot stand for them")
    return ranks, added[SPECIAL]


class Pieces(dict):
    """piece -> value of " " + piece; kept up to `most` pieces, then started anew."""

    def __init__(self, path: str, most: int = 600_000):
        import tiktoken

        super().__init__()
        ranks, self.special = load_ranks(path)
        self.most = most
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def value(self, text: str):
        raise NotImplementedError

    def __missing__(self, piece: str):
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Edge
        if len(self) >= self.most:
            self.clear()
        out = self.value(" " + piece)
        if len(piece) <= 64:
            self[piece] = out
        return out

    def parts(self, text: str):
        """Values of the pieces of a text without special strings, in order."""
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace() and rest:
                raise _Edge
            return [self.value(first), *map(self.__getitem__, rest)]
        except _Edge:
            first, *rest = _CUT.split(text)
            return [self.value(first), *(self.value(" " + p) for p in rest)]


class Ids(Pieces):
    """Token ids as little-endian unsigned 32-bit values."""

    def value(self, text: str) -> bytes:
        return array("I", self.merge(text)).tobytes()  # native order: little-endian on all machines Spark runs on

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL not in text:
            return b"".join(self.parts(text))
        mark = struct.pack("<I", self.special)
        return mark.join(b"".join(self.parts(t)) if t else b"" for t in text.split(SPECIAL))


class Counts(Pieces):
    """Token counts: pre-tokens proven to be one token count at once, the rest is merged."""

    def __init__(self, path: str, whole: frozenset[str], most: int = 600_000):
        super().__init__(path, most)
        self.whole = whole

    def value(self, text: str) -> int:
        if text in self.whole:
            return 1
        if NEWER.search(text):
            return len(self.merge(text))
        total = 0
        for token in _words.findall(text):
            total += 1 if token in self.whole else len(self.merge(token))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if SPECIAL not in text:
            return sum(self.parts(text))
        segments = text.split(SPECIAL)
        return len(segments) - 1 + sum(sum(self.parts(t)) for t in segments if t)
