"""Importance resampling towards a target corpus by bucket-partitioned inverted postings.

Features are runs of 1 to `longest` consecutive words, hashed into buckets. Every text becomes postings (bucket, document,
count), dealt out by ranges of buckets; one group co-groups the postings of its buckets with both corpora's counts of them,
computes the buckets' gains there and emits each document's contribution, and the contributions are reduced by document.
Postings travel packed, one row for each block of documents and range of buckets, with gaps and counts in a byte or so.
A frequent bucket never meets as a whole: a range is salted into groups of about `group_bytes`, and its counts, added up
before any exchange, are a few numbers beside each group. Drawing the best is a range sort with ranks from counts per task.

Defined results: a null text has no words; a document without features has weight 0; rows without an id have a null score
and are neither counted nor drawn; repeated rows each take part; equal scores go to the smaller id; extra columns are
ignored; without any document the result is empty, without a target text every target count is 0.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import partitions, stored
from siltstone.llm.text import as_bytes, blocks

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])  # after lowering
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_NONE = np.uint32(0xFFFFFFFF)
#: Bytes from which a text is read piece by piece.
LONG_TEXT = 8 << 20


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out.astype(np.uint32)


_CRC = _crc_table()


def crc_on(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, register: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each slice, all slices a byte at a time; long ones by themselves."""
    register = register.copy()
    size = ends - starts
    long = np.flatnonzero(size > 64)
    for k in long.tolist():
        register[k] = zlib.crc32(raw[starts[k] : ends[k]].tobytes(), int(register[k] ^ _NONE)) ^ 0xFFFFFFFF
    alive, at = np.flatnonzero((size > 0) & (size <= 64)), 0
    while len(alive):
        r = register[alive]
        register[alive] = _CRC[(r ^ raw[starts[alive] + at]) & np.uint32(255)] ^ (r >> np.uint32(8))
        at += 1
        alive = alive[size[alive] > at]
    return register


def pieces(raw: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """A lowered text in pieces that end between words."""
    at = 0
    while len(raw) - at > most:
        cut = _GAP.search(raw, at + most)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.start()
    yield raw[at:]


def features(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) sorted by bucket and text; words of each text; features of each text. Texts are lowered."""
    data = b"\0".join(texts)
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    owner = np.searchsorted(first, starts, side="right") - 1
    words = np.bincount(owner, minlength=len(texts))
    keys, register = [], np.full(len(starts), _NONE, dtype=np.uint32)
    for n in range(longest):  # n + 1 words: those that end at word k go on from those that ended at k - 1
        if n:
            register = register[:-1]
            register = _CRC[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
        register = crc_on(raw, starts[n:], ends[n:], register)
        own = owner[n:] == owner[: len(owner) - n]
        keys.append(((register ^ _NONE)[own] % np.uint32(buckets)).astype(np.int64) * len(texts) + owner[n:][own])
        if not len(register):
            break
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    text = key % len(texts)
    total = np.bincount(text, weights=count, minlength=len(texts)).astype(np.int64)
    return np.stack([text, key // len(texts), count]), words, total


def folded(texts: list[bytes], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of whole texts, very long ones read piece by piece, so that memory stays bounded."""
    if len(texts) > 1 or len(texts[0]) <= LONG_TEXT:
        return features(texts, buckets, longest)
    row, n_words, tail = np.zeros(buckets, dtype=np.int64), 0, b""
    for part in pieces(texts[0]):
        again = np.zeros(buckets, dtype=np.int64)
        if tail:  # the words carried over were counted with the piece before
            old = features([tail], buckets, longest)
            np.add.at(again, old[0][1], old[0][2])
            n_words -= int(old[1][0])
        found = features([tail + part], buckets, longest)
        np.add.at(row, found[0][1], found[0][2])
        row -= again
        n_words += int(found[1][0])
        tail = _tail(tail + part, longest - 1)
    at = np.flatnonzero(row)
    return np.stack([np.zeros_like(at), at, row[at]]), np.array([n_words]), np.array([row.sum()])


def _tail(raw: bytes, words: int) -> bytes:
    """The last words of a piece, all joined by a space, and a space."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _WORD[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)[-words:] if words else []
    return b"".join(raw[s:e] + b" " for s, e in edge)


def packed(key: np.ndarray, count: np.ndarray) -> bytes:
    """Rising keys as gaps and their counts, a byte each; 255 stands for a larger number in the list behind."""
    gap = np.diff(key, prepend=0)
    out = [np.array([len(key)], dtype=np.int64).tobytes()]
    for values in (gap, count):
        out += [np.minimum(values, 255).astype(np.uint8).tobytes()]
        out += [values[values >= 255].astype(np.int64).tobytes()]
    return zstandard.compress(b"".join(out), 3)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(2):
        values = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        big = np.flatnonzero(values == 255)
        values[big] = np.frombuffer(raw, np.int64, len(big), at + n)
        at += n + 8 * len(big)
        out.append(values)
    return np.cumsum(out[0]), out[1]


def postings(df: DataFrame, id_col: str, text_col: str, buckets: int, longest: int, parts: int) -> DataFrame:
    """Packed postings of df's texts, by block of documents and range of buckets (part); part -1: the block's documents."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24  # blocks are numbered within their task: a repeated task gives the same
        for pdf in batches:
            raw = [as_bytes(t).translate(_LOWER) for t in pdf["text"]]
            for s, e in blocks(raw):
                (doc, bucket, count), words, total = folded(raw[s:e], buckets, longest)
                rows = [(number, -1, e - s, None, list(pdf["id"].iloc[s:e]), words.tolist(), total.tolist())]
                cut = np.searchsorted(bucket, [-(-p * buckets // parts) for p in range(parts + 1)])
                for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if a < b:
                        rows.append((number, p, e - s, packed(bucket[a:b] * (e - s) + doc[a:b], count[a:b]), None, None, None))
                yield pd.DataFrame(rows, columns=["block", "part", "n", "data", "ids", "words", "features"])
                number += 1

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if kind != "string":  # numbers with nulls would reach pandas as floats
        rows = rows.withColumn("id", F.col("id").cast("string"))
    return rows.mapInPandas(run, "block long, part int, n int, data binary, ids array<string>, words array<long>, features array<long>")


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """part, bucket and how often its features occur: added up within tasks, then over them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for part, data, n in zip(pdf["part"], pdf["data"], pdf["n"], strict=True):
                key, count = unpacked(data)
                bucket = key // n
                have = sums.get(part)
                top = int(bucket[-1]) + 1
                if have is None or len(have) < top:
                    sums[part] = have = np.r_[have if have is not None else np.zeros(0, dtype=np.int64), np.zeros(top - (0 if have is None else len(have)), dtype=np.int64)]
                np.add.at(have, bucket, count)
        for part, have in sums.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"part": np.full(len(at), part, dtype=np.int32), "bucket": at, "n": have[at]})

    return rows.where("part >= 0").select("part", "data", "n").mapInPandas(run, "part int, bucket long, n long").groupBy("part", "bucket").agg(F.sum("n").alias(name))


def gain(t: int, s: int, target: int, source: int, buckets: int) -> int:
    """What a feature of the bucket adds to a document's weight."""
    return math.floor(1000 * math.log((t + 1) * (source + buckets) / ((s + 1) * (target + buckets))))


def weighted(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_text: str, buckets: int, longest: int, parts: int, group_bytes: int) -> DataFrame:
    """id, row (a number of its own), n_words, n_features, weight of every document."""
    made = stored(postings(docs, id_col, text_col, buckets, longest, parts), "postings")
    aimed = target.select(F.lit(0).alias("none"), F.col(f"`{target_text}`").alias("text"))
    aimed = stored(postings(aimed, "none", "text", buckets, longest, parts), "target-postings")
    total = lambda rows: int(rows.where("part = -1").agg(F.sum(F.aggregate("features", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0)
    source, wanted = total(made), total(aimed)
    counts = bucket_counts(made, "s").join(bucket_counts(aimed, "t"), ["part", "bucket"], "full").fillna(0)

    weight = made.where("part >= 0").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    salts = max(1, -(-weight // (parts * group_bytes)))
    left = made.where("part >= 0").select("part", "block", "data", "n").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    right = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # buckets x salts rows

    def contribute(key: tuple, own: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        gains = np.zeros(int(both["bucket"].max()) + 1, dtype=np.int64) if len(both) else np.zeros(1, dtype=np.int64)
        for b, s, t in zip(both["bucket"], both["s"], both["t"], strict=True):
            gains[b] = gain(int(t), int(s), wanted, source, buckets)
        out = []
        for block, data, n in zip(own["block"], own["data"], own["n"], strict=True):
            at, count = unpacked(data)
            sums = np.zeros(n, dtype=np.int64)
            np.add.at(sums, at % n, gains[at // n] * count)
            narrow = np.int32 if np.abs(sums).max(initial=0) < 2**31 else np.int64
            out.append((block, zstandard.compress(bytes([narrow == np.int32]) + sums.astype(narrow).tobytes(), 3)))
        return pd.DataFrame(out, columns=["block", "sums"])

    sent = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(contribute, "block long, sums binary")
    reduced = sent.groupBy("block").agg(F.collect_list("sums").alias("sums"))  # at most `parts` rows a block
    whole = made.where("part = -1").select("block", "ids", "words", "features").join(reduced, "block", "left")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, ids, words, n, sums in zip(pdf["block"], pdf["ids"], pdf["words"], pdf["features"], pdf["sums"], strict=True):
                weight = np.zeros(len(n), dtype=np.int64)
                for blob in sums if sums is not None else ():
                    raw = zstandard.decompress(blob)
                    weight += np.frombuffer(raw, np.int32 if raw[0] else np.int64, offset=1)
                yield pd.DataFrame({"id": ids, "row": (block << 16) + np.arange(len(n)), "n_words": words, "n_features": n, "weight": weight // np.maximum(n, 1)})

    out = whole.mapInPandas(add_up, "id string, row long, n_words long, n_features long, weight long")
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rank (1, 2, ... of the best, null for the others) beside all columns of scored (id, row, n_words, score among them)."""
    may = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    asked = scored.where(may)
    wanted = percent * asked.count() // 100
    order = [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()]

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), 0
        for pdf in batches:
            yield pdf.assign(task=task, seen=range(seen + 1, seen + len(pdf) + 1))
            seen += len(pdf)

    spark = scored.sparkSession
    placed = asked.select("row", "id", "score").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("row")
    placed = stored(placed.mapInPandas(number, "row long, task int, seen long"), "ranks")
    before, start = [], 0
    for r in placed.groupBy("task").agg(F.max("seen").alias("n")).orderBy("task").collect():  # one row for each task
        before.append((r["task"], start))
        start += r["n"]
    offsets = spark.createDataFrame(before, "task int, before long")
    ranks = placed.join(F.broadcast(offsets), "task").select("row", (F.col("before") + F.col("seen")).alias("rank")).where(F.col("rank") <= wanted)
    return scored.join(ranks, "row", "left")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    percent: int = 25,
    least_words: int = 20,
    seed: int = 7,
    buckets: int = 10_000,
    longest: int = 2,
    parts: int = 16,
    group_bytes: int = 8 << 20,
) -> DataFrame:
    """id, n_features, weight, score, rank of every document: `percent` of those with `least_words` words are drawn by Gumbel scores."""
    found = weighted(docs, target, id_col, text_col, target_text, buckets, longest, parts, group_bytes)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored(found.withColumn("score", F.col("weight") + noise), "resampling-scores")
    out = drawn(scored, percent, least_words)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
