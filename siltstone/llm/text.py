"""Vectorised text helpers shared by the corpus operators (they run inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the polynomial hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        have = _powers[base] = out
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**i; the hash of any slice comes from two of them."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def slice_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every slice [start, end); equal bytes give equal hashes wherever they stand."""
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None or text != text else text.encode("utf-8", "surrogatepass")


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lowered, of all texts in order; and each word's text index."""
    data = b" ".join(blobs).translate(_LOWER)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD_BYTE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    first = np.cumsum([0] + [len(b) + 1 for b in blobs])[:-1]
    owner = np.searchsorted(first, starts, side="right") - 1
    return slice_hashes(prefix(raw), starts, ends), owner.astype(np.int64)


def blocks(texts: list[bytes], most: int = 1 << 21, rows: int = 20_000) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of texts of about `most` bytes and at most `rows` texts each; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > most or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.diff(np.r_[starts, len(keys)])
