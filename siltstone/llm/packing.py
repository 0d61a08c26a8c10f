"""Best-fit packing of documents into fixed-length sequences by bin completion.

1. Documents are tokenised once, cut into pieces of at most `capacity` tokens (only longer documents are cut; the
   first piece takes the remainder) and stored as a small table of lengths.
2. The histogram of lengths (at most `capacity` entries, whatever the corpus) goes to the driver, where a bin
   completion search plans the bins: it takes the largest length left, enumerates the undominated fillings around it
   in best-fit order, applies one to as many bins as the counts allow and goes on; the first descent is the best-fit
   incumbent. It then backtracks depth-first over the steps with two fillings or more and prunes branches that cannot
   beat the incumbent. `nodes` bounds the alternatives tried (forced steps are free) and `width` the fillings of a
   step, never the result: every piece is placed whatever the bounds.
3. The plan is a list of slots, each a run of ranks of one length. Pieces get their rank within their length from
   per-partition counts and an offset, so no length has to meet in one task, and look their slot up.

Defined results: null and empty texts are one piece of the end token alone; repeated rows are pieces of their own;
extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.bpe import Ids
from siltstone.llm.tables import stored


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % capacity if n > capacity and n % capacity else min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and (task, seen): the piece is the seen-th of its length in its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, tail = Ids(path), end_id.to_bytes(4, "little")
        task, counts = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = enc.encode(text) + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, counts[length]))
                    counts[length] += 1
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32", "task", "seen"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, seen long")


def fillings(room: int, lengths: list[int], counts: dict[int, int], most: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(waste, ((length, how many), ...)) of undominated ways to fill `room`, least waste first.

    Dominated: an unused length can be added, or swapped in for a shorter one that is used. lengths: descending, those
    with counts left. At most `most` fillings are looked for, in best-fit (largest first) order.
    """
    found: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    rising, work = lengths[::-1], [0]
    least = rising[0] if rising else room + 1

    def spare(low: int, high: int, used: dict[int, int]) -> bool:
        """An unused length in [low, high]."""
        for i in range(bisect.bisect_left(rising, low), bisect.bisect_right(rising, high)):
            if counts[rising[i]] > used.get(rising[i], 0):
                return True
        return False

    def walk(at: int, left: int, used: list[tuple[int, int]]) -> None:
        work[0] += 1
        if left < least or at >= len(lengths):
            own = dict(used)
            if not spare(least, left, own) and not any(spare(n + 1, n + left, own) for n in own):
                found.append((left, tuple(used)))
            return
        for i in range(max(at, len(rising) - bisect.bisect_right(rising, left)), len(lengths)):
            n = lengths[i]
            for k in range(min(counts[n], left // n), 0, -1):
                walk(i + 1, left - k * n, [*used, (n, k)])
                if len(found) >= most or work[0] > 50 * most and found:
                    return
            if n == left:  # whatever is shorter is dominated
                return
        walk(len(lengths), left, used)

    walk(0, room, [])
    return sorted(found, key=lambda f: (f[0], [(-n, k) for n, k in f[1]]))


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int = 4000, width: int = 8) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, how many a bin), ...) and the number of bins of each. Bin completion over a histogram of lengths.

    Depth-first with backtracking: each step fills the bins of the largest length left. The first descent always takes
    the best-fitting filling, as often as the counts allow, and gives the incumbent. Steps with a single filling are
    forced; at all others the untried fillings stay open, those that repeat also for one bin alone. The search goes back
    to the last open step, takes its next filling (one of `nodes` alternatives) and best-fits from there on, pruned as
    soon as the bins so far and those that the rest needs at least are no fewer than the incumbent's.
    """
    total = sum(n * c for n, c in histogram.items())
    bound = -(-total // capacity)
    counts = {n: c for n, c in histogram.items() if c}
    rising = sorted(counts)
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []
    untried: list[tuple[int, list[tuple[tuple[tuple[int, int], ...], int]]]] = []  # steps before it and what is left to try
    best: list[tuple[tuple[tuple[int, int], ...], int]] = []
    best_bins, bins, placed, tried = 1 << 62, 0, 0, 0

    def put(pattern: tuple[tuple[int, int], ...], times: int) -> None:
        """Fills `times` bins, or empties them where negative."""
        nonlocal bins, placed
        for n, k in pattern:
            had = counts.get(n, 0)
            counts[n] = had - k * times
            if not had:
                bisect.insort(rising, n)
            elif not counts[n]:
                rising.pop(bisect.bisect_left(rising, n))
                del counts[n]
        bins += times
        placed += times * sum(n * k for n, k in pattern)

    def take(pattern: tuple[tuple[int, int], ...], times: int) -> None:
        done.append((pattern, times))
        put(pattern, times)

    def choices() -> list[tuple[tuple[tuple[int, int], ...], int]]:
        big = rising[-1]
        counts[big] -= 1
        room = capacity - big
        ways = fillings(room, [n for n in reversed(rising[: bisect.bisect_right(rising, room)]) if counts[n]], counts, width)
        counts[big] += 1
        out = []
        for _, way in ways:
            merged = {big: 1}
            for n, k in way:
                merged[n] = merged.get(n, 0) + k
            out.append((tuple(sorted(merged.items(), reverse=True)), min(counts[n] // k for n, k in merged.items())))
        return out + [(pattern, 1) for pattern, times in out if times > 1] if len(out) > 1 else out

    while True:
        while rising and bins - (placed - total) // capacity < best_bins:  # bins, and what the rest needs at least
            ways = choices()
            if len(ways) > 1:
                untried.append((len(done), ways[:0:-1]))
            take(*ways[0])
        if not rising and bins < best_bins:
            best, best_bins = list(done), bins
        while untried and not untried[-1][1]:
            untried.pop()
        if best_bins <= bound or not untried or tried >= nodes:
            return best
        at, ways = untried[-1]
        while len(done) > at:
            pattern, times = done.pop()
            put(pattern, -times)
        take(*ways.pop())
        tried += 1


def slots(plan: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, how many a bin, offset in the bin), by rising first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for pattern, times in plan:
        offset = 0
        for n, k in pattern:
            out.setdefault(n, []).append((taken.get(n, 0), first, k, offset))
            taken[n] = taken.get(n, 0) + k * times
            offset += k * n
        first += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, nodes: int = 4000) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut_up = stored(pieces(df, path, id_col, text_col, capacity, end_id), "pieces")
    per_task = cut_up.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    table = slots(plan_bins(histogram, capacity, nodes))
    # ranks before each task, by length: one row per task and length, never the pieces themselves
    before = per_task.selectExpr("length", "task", "sum(n) over (partition by length order by task) - n as before")
    ranked = cut_up.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("seen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            sequence, offset = np.empty(len(pdf), dtype=np.int64), np.empty(len(pdf), dtype=np.int64)
            for n in np.unique(length):
                rows, at = table[n], length == n
                s = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                inside = rank[at] - s[:, 0]
                sequence[at], offset[at] = s[:, 1] + inside // s[:, 2], s[:, 3] + inside % s[:, 2] * n
            yield pdf[["id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence, offset=offset)

    kind = df.schema[id_col].dataType.simpleString()
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
