"""Removal of every byte covered by a `length`-byte string that also starts anywhere else (default 200 bytes).

Sparse suffix arrays: in every window of `length` bytes the smallest hash of the window's (length / 2)-byte grams is an
anchor, chosen by content alone, so all copies of a repeated string hold the same anchor at the same place. Where the
whole context of an anchor (length / 2 bytes before, length after its start) repeats, all its windows repeat. The other
contexts of a shared anchor are sorted by deep-shallow sorting, once by what follows and once, reversed, by what precedes;
two suffix orders with their common prefixes tell for each of the length / 2 + 1 windows around an anchor whether another
occurrence agrees on both sides.

Anchors are dealt by gram and context; a context that a task meets again and again is known to repeat there and then, and
sends two rows only. Contexts are dealt to sorting tasks by their gram. Where more than `per_task` contexts share one, they
are dealt deeper, in `_SPLIT` ways: windows that start d bytes before the anchor, d in one of `_SPLIT` ranges, agree on all
bytes that every window of the range has, so those join the gram in the key; sorting then decides about that range.

Matches never cross texts. Grams, contexts and keys are compared by 64-bit hashes.
Defined results: null and empty texts have no bytes; texts shorter than `length` are kept; repeated rows repeat each
other like any copies; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.near_duplicates import Frequent
from siltstone.llm.suffix_order import deep_shallow
from siltstone.llm.tables import partitions, stored
from siltstone.llm.text import as_bytes, blocks, mix, prefix, slice_hashes

#: Ranges of window starts in which the contexts of a very frequent anchor are sorted.
_SPLIT = 8


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of `width` values; n - width + 1 results."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram hash, context hash) of all anchors of the texts."""
    gram = length // 2
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    ends = np.cumsum([len(b) for b in raw])
    owner = np.repeat(np.arange(len(raw)), np.diff(np.r_[0, ends]))
    first, last = (ends - [len(b) for b in raw])[owner], ends[owner]
    sums, at = prefix(data), np.arange(len(data) - gram + 1)
    h = slice_hashes(sums, at, at + gram)
    least = _sliding(h, length - gram + 1, np.minimum)  # of the window that starts here
    windows = np.arange(len(least))
    least[windows + length > last[: len(least)]] = 0  # it would cross into the next text
    pad = np.zeros(length - gram, dtype=np.uint64)
    reached = _sliding(np.r_[pad, least, pad], length - gram + 1, np.maximum)[: len(h)]
    pos = np.flatnonzero((reached == h) & (at + gram <= last[: len(h)]))
    left, right = np.minimum(gram, pos - first[pos]), np.minimum(length, last[pos] - pos)
    ctx = slice_hashes(sums, pos - left, pos + right) ^ mix((left * 4096 + right).astype(np.uint64))
    return owner[pos], pos - first[pos], h[pos].view(np.int64), ctx.view(np.int64)


def repeated_windows(group: np.ndarray, before: np.ndarray, n_before: np.ndarray, after: np.ndarray, n_after: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each occurrence and d = 0 .. half: does another one of its group agree on d bytes before and half - d after?

    before: reversed bytes before the anchor, after: bytes after its gram; zero beyond the given numbers of bytes. Only
    d = low .. high of each occurrence are looked at; a group has one range.
    """
    m, half = before.shape
    out = np.zeros((m, half + 1), dtype=bool)
    left_order, left_lcp = deep_shallow(group, before, n_before)
    right_order, right_lcp = deep_shallow(group, after, n_after)
    left, right = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for d in range(half + 1):
        left[left_order] = np.cumsum(left_lcp < d)
        right[right_order] = np.cumsum(right_lcp < half - d)
        able = np.flatnonzero((n_before >= d) & (n_after >= half - d) & (low <= d) & (d <= high))
        key = left[able] * (m + 1) + right[able]
        order = np.argsort(key, kind="stable")
        k = key[order]
        twin = np.zeros(len(k), dtype=bool)
        twin[1:] = k[1:] == k[:-1]
        twin[:-1] |= twin[1:]
        out[able[order[twin]], d] = True
    return out


def spans_of(covered: np.ndarray, uid: np.ndarray, pos: np.ndarray, length: int) -> pd.DataFrame:
    """Spans of the repeated windows: a run d1..d2 of windows covers [pos - d2, pos - d1 + length)."""
    edge = np.diff(np.pad(covered.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, d1 = np.nonzero(edge == 1)
    _, d2 = np.nonzero(edge == -1)
    return pd.DataFrame({"uid": uid[row], "start": pos[row] - (d2 - 1), "stop": pos[row] - d1 + length})


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    out: list[tuple[int, int]] = []
    order = np.argsort(starts, kind="stable")
    for s, e in zip(np.asarray(starts)[order].tolist(), np.asarray(stops)[order].tolist(), strict=True):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def with_spans(df: DataFrame, text_col: str = "text", length: int = 200, per_task: int = 40_000) -> DataFrame:
    """`row`, a struct of all columns of df, and `spans`, the byte spans (start, stop) to remove, possibly overlapping; null
    where there are none."""
    half, spark = length // 2, df.sparkSession
    n_parts = partitions(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])  # a struct: the user's names never meet ours
    own = [F.col(f"`{c}`") for c in df.columns if c in ("doc_id", text_col)]
    docs = df.select(row.alias("row"), F.xxhash64(F.lit(7), *own, *(c.isNull() for c in own)).alias("uid"))
    texts = docs.select("uid", F.col("row").getField(text_col).alias("text"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repeated = Frequent(1)
        for pdf in batches:
            raw, ids = [as_bytes(t) for t in pdf["text"]], pdf["uid"].to_numpy()
            for s, e in blocks(raw):
                text, pos, gram, ctx = anchors(raw[s:e], length)
                known = repeated.beyond(gram ^ mix(ctx.view(np.uint64)).view(np.int64), np.arange(len(gram)))
                yield pd.DataFrame({"gram": gram, "ctx": ctx, "uid": ids[s:e][text], "pos": pos, "known": known})

    found = stored(texts.mapInPandas(find, "gram long, ctx long, uid long, pos long, known boolean"), "anchors")

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted: kind 0, the whole context repeats; kind 1, one row per context."""

        def tell(rows: np.ndarray, last: bool) -> pd.DataFrame:
            inner = slice(1, len(rows) if last else len(rows) - 1)
            same = np.r_[False, (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1]), False]
            full, first = (same[:-1] | same[1:])[inner], ~same[:-1][inner]
            out = np.concatenate([rows[inner][full], rows[inner][first]])
            kind = np.r_[np.zeros(int(full.sum()), dtype=np.int32), np.ones(int(first.sum()), dtype=np.int32)]
            return pd.DataFrame({"kind": kind, "gram": out[:, 0], "uid": out[:, 2], "pos": out[:, 3]})

        held = None  # the row before, already told, and the last row, not yet told
        for pdf in batches:
            rows = pdf[["gram", "ctx", "uid", "pos"]].to_numpy(dtype=np.int64)
            if not len(rows):
                continue
            if held is None:
                held = np.array([[~rows[0, 0], 0, 0, 0]])  # differs from the first row
            rows = np.concatenate([held, rows])
            yield tell(rows, False)
            held = rows[-2:]
        if held is not None:
            yield tell(held, True)

    dealt = found.where("not known").repartition(n_parts, "gram", "ctx").sortWithinPartitions("gram", "ctx")
    rows = stored(dealt.mapInPandas(shared, "kind int, gram long, uid long, pos long"), "anchor-contexts")
    members = rows.where("kind = 1")
    sizes = members.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    several = members.join(sizes, "gram").select("uid", "pos", "gram", "n")
    whole = rows.where("kind = 0").select("uid", "pos").unionByName(found.where("known").select("uid", "pos"))
    wanted = whole.select("uid", "pos", F.lit(0).cast("long").alias("gram"), F.lit(0).cast("long").alias("n")).unionByName(several)
    listed = stored(wanted.groupBy("uid").agg(F.collect_set(F.struct("pos", "gram", "n")).alias("places")), "anchor-places")  # a set: equal rows share their uid, and a text's own anchors bound it

    with_places = texts.join(listed, "uid")
    edges = np.linspace(0, half + 1, _SPLIT + 1).astype(int)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """kind 0: a span; 1: a context to sort."""
        names = ["kind", "key", "uid", "pos", "stop", "low", "high", "before", "after"]
        for pdf in batches:
            out = []
            for uid, text, places in zip(pdf["uid"], pdf["text"], pdf["places"], strict=True):
                raw, sums, whole = as_bytes(text), None, []
                for p in places:
                    pos, n = p["pos"], p["n"]
                    left, right = min(half, pos), min(length, len(raw) - pos)
                    if n == 0:
                        if left + right >= length:
                            whole.append((pos - left, pos + right))
                        continue
                    own = (raw[pos - left : pos][::-1], raw[pos + half : pos + right])
                    if n <= per_task:
                        out.append((1, p["gram"], uid, pos, 0, 0, half, *own))
                        continue
                    sums = prefix(np.frombuffer(raw, dtype=np.uint8)) if sums is None else sums
                    for low, high in zip(edges[:-1].tolist(), (edges[1:] - 1).tolist(), strict=True):
                        if low <= left and length - high <= right:  # every window of the range has these bytes
                            key = slice_hashes(sums, np.array([pos - low]), np.array([pos + length - high])).view(np.int64)[0]
                            out.append((1, int(key) ^ low, uid, pos, 0, low, high, *own))
                out += [(0, 0, uid, s, e, 0, 0, None, None) for s, e in merged(*np.array(whole, dtype=np.int64).reshape(-1, 2).T)]
                if len(out) > 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    schema = "kind int, key long, uid long, pos long, stop long, low int, high int, before binary, after binary"
    made = stored(with_places.mapInPandas(contexts, schema), "contexts")
    buckets = max(1, -(-made.where("kind = 1").count() // per_task))
    to_sort = made.where("kind = 1").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def matrix(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(v.ljust(half, b"\0") for v in values), dtype=np.uint8).reshape(-1, half), values.str.len().to_numpy(dtype=np.int64)

        _, group = np.unique(pdf["key"].to_numpy(), return_inverse=True)
        covered = repeated_windows(group, *matrix(pdf["before"]), *matrix(pdf["after"]), pdf["low"].to_numpy(), pdf["high"].to_numpy())
        return spans_of(covered, pdf["uid"].to_numpy(), pdf["pos"].to_numpy(), length)

    sorted_spans = to_sort.groupBy("bucket").applyInPandas(compare, "uid long, start long, stop long")
    spans = made.where("kind = 0").select("uid", F.col("pos").alias("start"), "stop").unionByName(sorted_spans)
    per_text = spans.groupBy("uid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return docs.join(per_text, "uid", "left").select("row", "spans")


def removed(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the bytes, and the maximal runs taken out."""
    if spans is None or not len(spans):
        return raw, []
    gone = merged(np.array([s["start"] for s in spans]), np.array([s["stop"] for s in spans]))
    kept, at = [], 0
    for s, e in gone:
        kept.append(raw[at:s])
        at = e
    return b"".join([*kept, raw[at:]]), gone


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, per_task: int = 40_000) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, spans in zip(pdf["id"], pdf["text"], pdf["spans"], strict=True):
                raw = as_bytes(text)
                kept, gone = removed(raw, spans)
                rows.append((i, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    out = with_spans(source, "text", length, per_task).select(F.col("row.doc_id").alias("id"), "row.text", "spans")
    return out.mapInPandas(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def remove_repeats(df: DataFrame, text_col: str = "text", length: int = 200, per_task: int = 40_000) -> DataFrame:
    """df with repeated bytes taken out of its text; characters cut in part go whole. Other columns stay; null stays null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = [t if t is None or s is None or not len(s) else removed(as_bytes(t), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)]
        return pd.Series(out, dtype=object)

    found = with_spans(df, text_col, length, per_task)
    own = lambda c: F.col("row").getField(c)
    return found.select(*((cut(own(c), F.col("spans")) if c == text_col else own(c)).alias(c) for c in df.columns))
