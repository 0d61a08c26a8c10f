"""Katz backoff language model over word n-grams of any order, with tables in the shared folder.

    P(w | h) = d_k(c) c(h w) / C(h)        if h w was seen, c its count, h the k - 1 words before
             = alpha(h) P(w | shorter h)   if not;  alpha(h) = (1 - sum of P(seen | h)) / (1 - sum of P(seen | shorter h))
    P(w)     = d_1(c) c(w) / N, and the mass they free is the probability of the one unknown word
(alpha = 1 for a context that training has not seen.) Counts up to `TOP` are Good-Turing discounted in Katz's
renormalised form, one set of factors an order. Katz leaves larger counts alone; here they (and those whose counts of
counts cannot support a factor) take d(c) = c / (c + 1), the Good-Turing estimate of a Zipf law with exponent 2: a context
whose words are all frequent would otherwise free no mass and give every other word probability 0. Texts start from start
marks and close with an end token.

1. Words are counted. The most frequent ones, at most `CODES`, are known to all tasks: their ranks are codes of three bytes at most.
2. Every batch of texts sends its distinct n-grams, packed, to buckets of their last word (frequent words are spread over
   several by the word before). Sorted by last word, word before and so on, the counts of all shorter n-grams with that
   ending are sums of runs, so the longest seen one of every token and its discount are settled there (`settle`).
   Training n-grams and, for tokens that fall back, questions about their contexts go on, packed, to buckets of the
   context's last word, where totals and backoff weights of all contexts come together (`weigh`).
3. Sums per text (kept per batch) and the answers give the scores; one text's numbers never meet another's words.

Tables below the shared folder, partitioned by kind: n-grams (last word, words before, count) and contexts (words, total,
alpha). One pair of frequent words cannot be spread further: its distinct n-grams and two bytes an occurrence meet in one
task. Words are 48-bit hashes (two of a billion words seldom share one), contexts 64-bit hashes of theirs.
Defined results: null and empty texts are one end token; repeated rows each give their row; without training rows every
token is unknown and P(unknown) = 1, score 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored
from siltstone.llm.text import as_bytes, blocks, mix, word_hashes

TOP = 5
#: Bound of the list of frequent words that every task knows (32 bytes each).
CODES = 500_000
#: Buckets that a task settles one after the other: each is small enough for a worker's memory.
PARTS = 4
_ESCAPE, START = 0xFFFFFF, 0xFFFFFE
_RARE = np.uint64(1 << 48)
#: Hash of the end token; mix() is a bijection, so it is as unlikely as any word's.
END = (int(mix(np.array([1], dtype=np.uint64))[0]) >> 16) | (1 << 48)


def discounts(counts_of_counts: dict[int, int], top: int = TOP) -> np.ndarray:
    """d[1..top] (d[0] unused): Katz's factors, or r / (r + 1) where the counts of counts cannot support them."""
    n = [counts_of_counts.get(r, 0) for r in range(top + 2)]
    d = np.array([1.0, *(r / (r + 1) for r in range(1, top + 1))])
    tail = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    for r in range(1, top + 1):
        if n[r] and tail < 1:
            x = ((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail)
            if 0 < x < 1:
                d[r] = x
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for every count."""
    return np.where(c < len(d), d[np.minimum(c, len(d) - 1)] * c, c * (c / (c + 1.0)))


def tokens(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) of every token of the texts, ends included."""
    words, owner = word_hashes(raw)
    n = np.bincount(owner, minlength=len(raw))
    last = np.cumsum(n + 1) - 1
    w = np.empty(len(words) + len(raw), dtype=np.uint64)
    inner = np.ones(len(w), dtype=bool)
    inner[last] = False
    w[inner], w[last] = (words >> np.uint64(16)) | _RARE, END
    return w, np.repeat(np.arange(len(raw)), n + 1)


def before(w: np.ndarray, text: np.ndarray, by: int) -> np.ndarray:
    """The word `by` places before each token; the start mark where the text has none."""
    out = np.full(len(w), START, dtype=np.uint64)
    same = text[by:] == text[: len(text) - by]
    out[by:][same] = w[: len(w) - by][same]
    return out


@dataclass
class Words:
    """Frequent words (at most `CODES`): their hashes in order, the code of each, and by code (the rank by count) their
    counts and how many buckets each is spread over."""

    buckets: int
    hashes: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    ways: np.ndarray

    def coded(self, w: np.ndarray) -> np.ndarray:
        """Hashes of frequent words replaced by their codes."""
        if not len(self.hashes):
            return w
        at = np.minimum(np.searchsorted(self.hashes, w), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w, self.codes[at], w)

    def bucket(self, w: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """Bucket of a word, or the one of its buckets that the word `by` selects."""
        out = mix(w + np.uint64(1))
        if by is not None and len(self.ways):
            frequent = np.flatnonzero(w < len(self.ways))
            out[frequent] += mix(by[frequent] + np.uint64(1)) % self.ways[w[frequent].astype(np.int64)]
        return (out % np.uint64(self.buckets)).astype(np.int64)

    def context_bucket(self, ctx: list[np.ndarray]) -> np.ndarray:
        """Bucket of a context, nearest word first."""
        return self.bucket(ctx[0]) if len(ctx) == 1 else self.bucket(ctx[0], ctx[1])

    def spread(self, w: np.ndarray) -> np.ndarray:
        """Is the word spread over several buckets?"""
        out = np.zeros(len(w), dtype=bool)
        frequent = w < len(self.ways)
        out[frequent] = self.ways[w[frequent].astype(np.int64)] > 1
        return out

    def count(self, w: np.ndarray, known: np.ndarray, counts: np.ndarray, start: int) -> np.ndarray:
        """Training counts of coded words; `known` and `counts` give those of the rarer ones."""
        out = np.zeros(len(w), dtype=np.int64)
        frequent = w < len(self.counts)
        out[frequent] = self.counts[w[frequent].astype(np.int64)]
        out[w == START] = start
        if len(known):
            rest = np.flatnonzero(w >= _RARE)
            at = np.minimum(np.searchsorted(known, w[rest]), len(known) - 1)
            out[rest] = np.where(known[at] == w[rest], counts[at], 0)
        return out


_CODEC: dict[str, object] = {}


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of whole or floating numbers, each in the narrowest type, byte planes apart, compressed."""
    if not _CODEC:
        _CODEC.update(z=zstandard.ZstdCompressor(level=1), x=zstandard.ZstdDecompressor())
    out = [struct.pack("<B", len(columns))]
    for c in columns:
        if c.dtype == np.float64:
            width, kind, c = 8, 1, c.view(np.uint64)
        else:
            top, kind = int(c.max(initial=0)), 0
            width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
        planes = np.ascontiguousarray(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        body = _CODEC["z"].compress(planes.tobytes())
        out += [struct.pack("<BBII", width, kind, len(c), len(body)), body]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    if not _CODEC:
        _CODEC.update(z=zstandard.ZstdCompressor(level=1), x=zstandard.ZstdDecompressor())
    out, at = [], 1
    for _ in range(blob[0]):
        width, kind, n, size = struct.unpack_from("<BBII", blob, at)
        at += 10
        planes = np.frombuffer(_CODEC["x"].decompress(blob[at : at + size], max_output_size=max(n * width, 1)), dtype=np.uint8).reshape(width, n)
        c = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()
        out.append(c.view(np.float64) if kind else c)
        at += size
    return out


def pack_words(w: np.ndarray) -> list[np.ndarray]:
    """Two columns: codes, and the hashes of the words that have none."""
    rare = w >= _RARE
    return [np.where(rare, _ESCAPE, w).astype(np.uint32), w[rare] - _RARE]


def unpack_words(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = codes.astype(np.uint64)
    out[codes == _ESCAPE] = hashes.astype(np.uint64) + _RARE
    return out


def runs_of(key: np.ndarray, *then: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Every key and the places that have it, in the order of `then`."""
    if len(key):
        at = np.lexsort((*then[::-1], key))
        edges = np.flatnonzero(np.r_[True, key[at[1:]] != key[at[:-1]], True])
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            yield int(key[at[s]]), at[s:e]


def gathered(blobs, words: int) -> list[np.ndarray]:
    """Columns of all blobs one behind the other; the first `words` are words (two stored columns each)."""
    parts = []
    for b in blobs:
        cols = unpacked(b)
        parts.append([unpack_words(*cols[2 * k : 2 * k + 2]) for k in range(words)] + cols[2 * words :])
    if not parts:
        return []
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def unigram_table(df: DataFrame, train: str) -> DataFrame:
    """w, c: every word of the training texts and its count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"w": w.view(np.int64), "c": c})

        for pdf in batches:
            raw = [as_bytes(t) for t in pdf.loc[pdf[train].to_numpy(dtype=bool), "text"]]
            for s, e in blocks(raw, 1 << 20):
                held.append(tokens(raw[s:e])[0])
                size += len(held[-1])
                if size > 2_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return df.mapInPandas(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Unigrams:
    total: int
    words: int
    d: np.ndarray
    unknown: float

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.total + 0.1 * (self.words + 1)))

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.total, 1), self.unknown)


def summary(unigrams: DataFrame) -> Unigrams:
    few = {r["c"]: r["n"] for r in unigrams.where(F.col("c") <= TOP + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    large = F.when(F.col("c") > TOP, F.col("c") * (F.col("c") / (F.col("c") + 1.0)))
    row = unigrams.agg(F.sum("c").alias("total"), F.count("*").alias("words"), F.sum(large).alias("large")).first()
    total, d = row["total"] or 0, discounts(few)
    kept = sum(d[r] * r * n for r, n in few.items() if r <= TOP) + (row["large"] or 0.0)
    return Unigrams(total, row["words"], d, 1 - kept / total if total else 1.0)


def frequent_words(unigrams: DataFrame, buckets: int, share: float) -> Words:
    """The most frequent words, whole classes of similar counts, at most `CODES`."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r["s"], r["n"]) for r in unigrams.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, held = None, 0
    for s, n in sizes:  # some 16 classes a power of two
        if held + n > CODES:
            break
        cut, held = s, held + n
    rows = unigrams.where(step >= cut if cut is not None else F.lit(False)).toPandas().sort_values(["c", "w"], ascending=[False, True])
    hashes, counts = rows["w"].to_numpy(dtype=np.int64).view(np.uint64), rows["c"].to_numpy(dtype=np.int64)
    codes = np.argsort(hashes)
    ways = np.minimum(buckets, (counts / share).astype(np.int64) + 1).astype(np.uint64)
    return Words(buckets, hashes[codes], codes.astype(np.uint64), counts, ways)


_SENT = "task long, bucket long, batch long, ids binary, blob binary"


def sent_ngrams(df: DataFrame, train: str, words: Words, order: int, per_batch: int = 1_000_000) -> DataFrame:
    """The distinct n-grams of each batch of texts, by bucket: last words in runs, words before, training counts,
    occurrences, and the text of every occurrence as a place in the batch's `ids` (sent once a batch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        ids: list = []
        size = number = 0

        def flush() -> pd.DataFrame:
            w, text, trained = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            cols = [w, *(before(w, text, k) for k in range(1, order))]
            n_tokens = np.bincount(text, minlength=len(ids))
            bucket = words.bucket(w, cols[1]).astype(np.int32)
            at = np.lexsort((*cols[::-1], bucket))
            for k in range(order):
                cols[k] = cols[k][at]
            text, trained, bucket = text[at], trained[at], bucket[at]
            del w
            new = np.r_[True, bucket[1:] != bucket[:-1]]
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            seen, each = np.add.reduceat(trained.astype(np.int64), at), np.diff(np.r_[at, len(text)])
            own = packed([*(np.array(x, dtype=np.uint64) for x in zip(*ids, strict=True)), n_tokens])  # id, has an id, trained
            batch, out = TaskContext.get().partitionId() * 1_000_000 + number, []
            for b in np.unique(bucket).tolist():
                lo, hi = np.searchsorted(bucket, [b, b + 1])
                i, j = np.searchsorted(at, [lo, hi])
                parts = [x for c in cols for x in pack_words(c[at[i:j]])]
                out.append((b // PARTS, b, batch, None if out else own, packed([*parts, seen[i:j], each[i:j], text[lo:hi]])))
            return pd.DataFrame(out, columns=["task", "bucket", "batch", "ids", "blob"])

        for pdf in batches:
            raw, trained = [as_bytes(t) for t in pdf["text"]], pdf[train].to_numpy(dtype=bool)
            rows = list(zip(pdf["id"].to_numpy().view(np.uint64), pdf["has"], trained, strict=True))
            for s, e in blocks(raw, 1 << 20):
                if held and (size > per_batch or len(ids) + e - s > 60_000):
                    yield flush()
                    ids, size, number = [], 0, number + 1
                w, text = tokens(raw[s:e])
                held.append((words.coded(w), (text + len(ids)).astype(np.int32), trained[s:e][text]))
                ids += rows[s:e]
                size += len(w)
        if held:
            yield flush()

    return df.mapInPandas(run, _SENT)


def dealt(unigrams: DataFrame, words: Words, most: int = 1_000_000) -> DataFrame:
    """task and packed (w, c) of the words that have no code (each has one bucket)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            w, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            task = words.bucket(w) // PARTS
            rows = [(t, packed([w[at] - _RARE, c[at]])) for t, at in runs_of(task, w)]
            return pd.DataFrame(rows, columns=["task", "counts"])

        for pdf in batches:
            w = words.coded(pdf["w"].to_numpy().view(np.uint64))
            rare = w >= _RARE
            held.append((w[rare], pdf["c"].to_numpy()[rare]))
            if sum(len(x) for x, _ in held) > most:
                yield flush()
        if held:
            yield flush()

    return unigrams.mapInPandas(run, "task long, counts binary")


def rare_counts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words without a code and their counts, by rising hash."""
    if not len(pdf):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    w, c = gathered(pdf["counts"], 0)
    order = np.argsort(w)
    return w[order].astype(np.uint64) + _RARE, c[order].astype(np.int64)


_SETTLED = "kind int, k int, task long, a long, b long, last binary, blob binary"
_SUMS, _IDS, _COUNTS, _NGRAMS, _ASKS = range(5)
#: What an answer adds up: log alpha and log C(h), log alpha alone, or minus log C(h).
_BOTH, _ALPHA, _LESS = range(3)


class Settled:
    """What a task has settled: columns for the tasks of contexts, sums per text, counts of counts."""

    def __init__(self, words: Words):
        self.words = words
        self.columns: dict[tuple[int, int, int], list[list[np.ndarray]]] = {}
        self.sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.counts: dict[tuple[int, int], int] = {}

    def send(self, kind: int, k: int, ctx: list[np.ndarray], numbers: list[np.ndarray], last: np.ndarray | None = None) -> None:
        """Keeps rows for the tasks of their contexts; last words go into a column of their own."""
        for task, at in runs_of(self.words.context_bucket(ctx) // PARTS):
            own = [x for g in ctx for x in pack_words(g[at])] + [x[at].astype(np.uint32 if x.max(initial=0) < 1 << 32 else np.uint64) for x in numbers]
            self.columns.setdefault((kind, k, task), []).append([*(pack_words(last[at]) if last is not None else []), *own])

    def rows(self) -> Iterator[tuple]:
        for (kind, k, task), parts in self.columns.items():
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield kind, k, task, 0, 0, packed(cols[:2]) if kind == _NGRAMS else None, packed(cols[2:] if kind == _NGRAMS else cols)
        for batch, parts in self.sums.items():
            own, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            numbers = np.concatenate([x for _, x in parts], axis=1)
            total = [np.bincount(at, weights=x) for x in numbers]
            yield _SUMS, 0, 0, batch, 0, None, packed([np.diff(own.astype(np.int64), prepend=0), *(x.astype(np.int64) for x in total[2:]), *total[:2]])
        for (k, r), n in self.counts.items():
            yield _COUNTS, k, 0, r, n, None, None


def settle_bucket(sent: pd.DataFrame, known: tuple[np.ndarray, np.ndarray], into: Settled, uni: Unigrams, order: int, start: int, end: int) -> None:
    """Settles all n-grams of one bucket: (batch, blob) of every batch."""
    texts, sizes, cols = [], [], []
    for blob in sent["blob"]:
        part = unpacked(blob)
        texts.append(part.pop().astype(np.uint16))
        w = [unpack_words(*part[2 * k : 2 * k + 2]) for k in range(order)]
        cols.append([*w, *(x.astype(np.int32) for x in part[2 * order :])])
        sizes.append(len(w[0]))
    *grams, c, each = (np.concatenate(x) for x in zip(*cols, strict=True))
    del cols
    at = np.lexsort(grams[::-1])
    grams, c = [g[at] for g in grams], c[at].astype(np.int64)
    place = np.empty(len(at), dtype=np.int64)  # of each sent n-gram in sorted order
    place[at] = np.arange(len(at))
    c1 = into.words.count(grams[0], *known, start)
    new = np.r_[True, grams[0][1:] != grams[0][:-1]]
    level, lower, value = np.ones(len(c), dtype=np.int8), [c1], np.log10(uni.probability(c1))
    small = np.zeros(len(c), dtype=np.int64)  # (k - 2) * TOP + count of the longest seen n-gram, where that is small
    for k in range(2, order + 1):
        new[1:] |= grams[k - 1][1:] != grams[k - 1][:-1]
        first = np.flatnonzero(new)
        sums = np.add.reduceat(c, first)
        seen = sums[np.cumsum(new) - 1]
        hit = seen > 0
        level[hit] = k
        value = np.where(hit, np.log10(np.where(seen > TOP, seen * (seen / (seen + 1.0)), np.maximum(seen, 1))), value)
        small = np.where(hit, np.where(seen <= TOP, (k - 2) * TOP + seen, 0), small)
        trained = first[sums > 0]
        if k == 2 < order:  # contexts spread over several buckets get their pairs apart; all others see them in longer n-grams
            trained = trained[into.words.spread(grams[1][trained])]
        if k in (2, order):
            # where the run of every shorter ending begins: 1 for the pair, 2 for the triple and so on up to the n-gram itself
            begins = np.full(len(trained), 1 << (k - 1))
            fresh = np.r_[True, np.diff(grams[0][trained]) != 0] if len(trained) else np.zeros(0, dtype=bool)
            for j in range(2, k):
                fresh[1:] |= np.diff(grams[j - 1][trained]) != 0
                begins += fresh << (j - 1)
            into.send(_NGRAMS, k, [g[trained] for g in grams[1:k]], [begins, seen[trained], *(x[trained] for x in lower)], grams[0][trained])
        for r, n in zip(*np.unique(sums[(sums > 0) & (sums <= TOP + 1)], return_counts=True), strict=True):
            into.counts[k, int(r)] = into.counts.get((k, int(r)), 0) + int(n)
        lower.insert(0, seen)
    # less the log of the context's count of the token behind
    value -= np.where((lower[1] > 0) & (grams[0] != end), np.log10(np.maximum(lower[1], 1)), 0)
    base = uni.base(c1)

    edges, lost = np.cumsum([0, *sizes]), []
    for batch, text, lo, hi in zip(sent["batch"], texts, edges[:-1], edges[1:], strict=True):
        e = np.repeat(place[lo:hi], each[lo:hi])
        own, text_of = np.unique(text, return_inverse=True)
        n, m = len(own), (order - 1) * TOP + 1
        count = np.bincount(text_of * m + small[e], minlength=m * n).reshape(n, m).T[1:]
        sums = [np.bincount(text_of, weights=x[e], minlength=n) for x in (base, value, c1 > 0)]
        into.sums.setdefault(batch, []).append((own, np.concatenate([sums, count]).astype(np.float64)))
        fell = level[e] < order
        lost.append(np.stack([e[fell], batch * 65_536 + text[fell].astype(np.int64)]))
    e, where = np.concatenate(lost, axis=1)
    for k in range(2, order + 1):
        mode = np.full(len(e), _BOTH) if k == order else np.where(level[e] < k, _ALPHA, _LESS)
        asks = level[e] <= k if k < order else level[e] < k
        ctx = [g[e[asks]] for g in grams[1:k]]
        into.send(_ASKS, k, ctx, [mode[asks], where[asks]])


def settle(sent: DataFrame, unigrams: DataFrame, words: Words, uni: Unigrams, order: int, start: int) -> DataFrame:
    """Settles all buckets; rows of several kinds (see the constants) that go into one table partitioned by kind."""
    end = int(words.coded(np.array([END], dtype=np.uint64))[0])

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        into, known = Settled(words), rare_counts(right)
        for _, part in left.groupby("bucket"):
            settle_bucket(part, known, into, uni, order, start, end)
        rows = [(_IDS, 0, 0, b, 0, None, x) for b, x in zip(left["batch"], left["ids"], strict=True) if x is not None]
        return pd.DataFrame([*rows, *into.rows()], columns=[x.split()[0] for x in _SETTLED.split(", ")])

    return sent.groupBy("task").cogroup(dealt(unigrams, words).groupBy("task")).applyInPandas(run, _SETTLED)


def folded(ctx: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key of the words of a context."""
    h = mix(ctx[0] + np.uint64(1))
    for c in ctx[1:]:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


_WEIGHED = "kind int, k int, a long, blob binary"
_ANSWERS, _CONTEXTS = range(2)


def weigh(settled: DataFrame, unigrams: DataFrame, words: Words, uni: Unigrams, d: list[np.ndarray], order: int, start: int) -> DataFrame:
    """Totals and exactly normalised backoff weights of all contexts, and the answers to what was asked about them."""

    def weigh_bucket(grams: dict[int, tuple], asked: dict[int, tuple], known: tuple[np.ndarray, np.ndarray], out: list[tuple], answers: list[tuple]) -> None:
        shorter = None
        for k in range(2, order + 1):
            h = np.zeros(0, dtype=np.uint64)
            if k in grams and len(grams[k][-1]):
                *ctx, c, low = grams[k]
                c, low = c.astype(np.int64), low.astype(np.int64)
                h = folded(ctx)
                at = np.argsort(h, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(h[at]) != 0])
                ctx = [x[at[first]] for x in ctx]
                c, low, h = c[at], low[at], h[at[first]]
                total = np.add.reduceat(c, first)
                freed = np.add.reduceat(c - discounted(c, d[k]), first)
                if k == 2:
                    taken = np.add.reduceat(uni.probability(low), first)
                else:
                    over = words.count(ctx[0], *known, start) if k == 3 else shorter[1][np.searchsorted(shorter[0], folded(ctx[:-1]))]
                    taken = np.add.reduceat(discounted(low, d[k - 1]), first) / over
                alpha = freed / total / (1 - taken)
                shorter = (h, total)
                at = np.lexsort((alpha, ctx[0]))
                out.append((_CONTEXTS, k, 0, packed([*(x for w in ctx for x in pack_words(w[at])), total[at], alpha[at]])))
            if k in asked and len(h):  # a context that training has not seen adds nothing
                *ask, mode, where = asked[k]
                key = folded(ask)
                at = np.minimum(np.searchsorted(h, key), len(h) - 1)
                hit = h[at] == key
                at, mode = at[hit], mode[hit]
                value = np.where(mode == _LESS, 0, np.log10(alpha[at])) + np.where(mode == _BOTH, 1, np.where(mode == _LESS, -1, 0)) * np.log10(total[at])
                answers.append((where[hit].astype(np.int64), value))

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        answers: list[tuple] = []
        known = rare_counts(right)
        grams: dict[int, list[tuple]] = {}  # (words before, count, count of the shorter one)
        for size, blob in zip(left.loc[left["kind"] == _NGRAMS, "k"], left.loc[left["kind"] == _NGRAMS, "blob"], strict=True):
            cols = gathered([blob], size - 1)
            w, begins, c = cols[: size - 1], cols[size - 1], cols[size:]
            for k in range(2, size + 1):  # a shorter n-gram is counted where its run begins
                own = begins & (1 << (k - 1)) > 0
                if k == 2 < size:
                    own &= ~words.spread(w[0])
                grams.setdefault(k, []).append((*(x[own] for x in w[: k - 1]), c[size - k][own], c[size - k + 1][own]))
        held = {k: tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for k, parts in grams.items()}
        del grams
        asked = {k: tuple(gathered(left.loc[(left["k"] == k) & (left["kind"] == _ASKS), "blob"], k - 1)) for k in range(2, order + 1)}
        place = [{k: words.context_bucket(list(x[: k - 1])) for k, x in of.items() if x} for of in (held, asked)]
        for b in range(key[0] * PARTS, (key[0] + 1) * PARTS):
            weigh_bucket(*({k: tuple(c[at[k] == b] for c in of[k]) for k in at} for of, at in zip((held, asked), place, strict=True)), known, out, answers)
        if answers:
            where, value = (np.concatenate(x) for x in zip(*answers, strict=True))
            own, at = np.unique(where, return_inverse=True)
            value = np.bincount(at, weights=value)
            out += [(_ANSWERS, 0, batch, packed([own[at] & 0xFFFF, value[at]])) for batch, at in runs_of(own >> 16)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in _WEIGHED.split(", ")])

    left = settled.where(F.col("kind").isin(_NGRAMS, _ASKS)).select("task", "kind", "k", "blob")
    return left.groupBy("task").cogroup(dealt(unigrams, words).groupBy("task")).applyInPandas(run, _WEIGHED)


@dataclass
class Tables:
    """The fitted model: tables in the shared folder and the few numbers that go with them."""

    unigrams: DataFrame
    settled: DataFrame
    weighed: DataFrame
    words: Words
    uni: Unigrams
    d: list[np.ndarray] = field(default_factory=list)

    def _rows(self, blobs: DataFrame, columns: list[str], words: list[int], schema: str) -> DataFrame:
        """Unpacked rows; `words` is the number of words in each packed column, which come first there."""
        hashes = self.words.hashes[np.argsort(self.words.codes)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    cols = []
                    for blob, n in zip(row, words, strict=True):
                        own = gathered([blob], n)
                        for c in own[:n]:
                            frequent = c < len(hashes)
                            c[frequent] = hashes[c[frequent].astype(np.int64)]
                        cols += own
                    yield pd.DataFrame({n: c.view(np.int64) if c.dtype == np.uint64 else c for n, c in zip(columns, cols, strict=True)})

        return blobs.mapInPandas(run, schema)

    def ngrams(self, k: int) -> DataFrame:
        """w, h1 (the word before), ..., c of every k-gram of the training texts; words are hashes (the start mark a small number)."""
        order = len(self.d) - 1
        names = ["w", *(f"h{j}" for j in range(1, order)), "begins", *(f"c{j}" for j in range(order, 0, -1))]
        blobs = self.settled.where((F.col("kind") == _NGRAMS) & (F.col("k") == order)).select("last", "blob")
        rows = self._rows(blobs, names, [1, order - 1], ", ".join(f"{n} long" for n in names))
        rows = rows.select("w", *(f"h{j}" for j in range(1, k)), F.col(f"c{k}").alias("c"))
        return rows if k == order else rows.distinct()

    def contexts(self, k: int) -> DataFrame:
        """h1, ..., total (its occurrences), alpha (the backoff weight) of every context of k - 1 words."""
        names = [*(f"h{j}" for j in range(1, k)), "total", "alpha"]
        blobs = self.weighed.where((F.col("kind") == _CONTEXTS) & (F.col("k") == k)).select("blob")
        return self._rows(blobs, names, [k - 1], ", ".join(f"{n} {'double' if n == 'alpha' else 'long'}" for n in names))


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, per_bucket: int = 400_000) -> tuple[DataFrame, Tables]:
    """Fits an `order`-gram model (2 or more) on the rows where `train` holds and scores all rows: id, held_out, n_tokens,
    n_known, train_tokens, base_score, score; and the tables of the model."""
    own = F.col(id_col).cast("long")
    rows = df.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNotNull().alias("has"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    unigrams = stored(unigram_table(rows, "train"), "unigrams")
    uni = summary(unigrams)
    buckets = PARTS * max(1, -(-uni.total // (per_bucket * PARTS)))
    words = frequent_words(unigrams, buckets, max(uni.total / buckets / 4, 1.0))
    start = rows.where("train").count()  # every training text starts once
    settled = stored(settle(sent_ngrams(rows, "train", words, order), unigrams, words, uni, order, start), "katz", partition_by=["kind"])
    few: list[dict[int, int]] = [{} for _ in range(order + 1)]
    for r in settled.where(F.col("kind") == _COUNTS).groupBy("k", "a").agg(F.sum("b").alias("n")).collect():
        few[r["k"]][r["a"]] = r["n"]
    d = [uni.d, uni.d, *(discounts(few[k]) for k in range(2, order + 1))]
    weighed = stored(weigh(settled, unigrams, words, uni, d, order, start), "katz-weights", partition_by=["kind"])
    logs = np.concatenate([np.log10(d[k][1:]) for k in range(2, order + 1)])

    def total(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, has, trained, n_tokens = unpacked(left.loc[left["kind"] == _IDS, "blob"].iloc[0])
        n = len(ids)
        known, base, value = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
        for blob in left.loc[left["kind"] == _SUMS, "blob"]:
            own, seen, *small, own_base, own_value = unpacked(blob)
            own = np.cumsum(own.astype(np.int64))
            known[own] += seen.astype(np.int64)
            base[own] += own_base
            value[own] += own_value + logs @ np.stack(small).astype(np.float64)
        for blob in right["blob"]:
            own, answer = unpacked(blob)
            value[own.astype(np.int64)] += answer
        value -= math.log10(start) if start else 0.0
        shown = pd.Series(ids.astype(np.uint64).view(np.int64)).astype("Int64").where(pd.Series(has == 1))
        return pd.DataFrame({"id": shown, "held_out": trained == 0, "n_tokens": n_tokens.astype(np.int64), "n_known": known, "base_score": base, "score": value})

    texts = settled.where(F.col("kind").isin(_SUMS, _IDS)).select("kind", F.col("a").alias("batch"), "blob")
    answers = weighed.where(F.col("kind") == _ANSWERS).select(F.col("a").alias("batch"), "blob")
    out = texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(total, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    result = out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(uni.total).cast("long").alias("train_tokens"), "base_score", "score")
    return result, Tables(unigrams, settled, weighed, words, uni, d)
