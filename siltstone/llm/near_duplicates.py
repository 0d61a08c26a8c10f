"""Set-similarity join of documents on word n-grams: token-combination prefixes, then exact verification.

A document's set holds the hashes of its distinct k-word shingles, in hash order. Equal sets form one class, so copies
are never compared. Let t(n) be the most tokens of a set of size n that a set of Jaccard similarity num / den or more can
lack. The join takes extended prefixes of window(n) = t(n) + 1 + max(1, t(n) / 2) tokens (all of a smaller set): two similar sets share at least
reach(n) = window(n) - t(n) of them, n the smaller size. Tokens of prefixes are of two classes:

1. Rare ones, held by the prefixes of 2 to `rare` classes, are indexed singly and give their pairs.
2. Frequent ones are not worth a pair each. Similar sets that share no rare token share reach(n) frequent ones, so only
   sets with that many go on, and those index token combinations. Sets of more than a few tokens are dealt to m ranges of
   the hash space, with m above the number of tokens in which a similar set may differ, and the tokens of each range are
   one combination: at least one is equal on both sides, and unrelated texts around a shared passage hardly ever have one
   in common. m follows from the level floor(log n) to the base den / num; similar sizes are at most one level apart, so
   a set indexes its own level and the next. Empty ranges break the guarantee: m, and where sets are short several
   independent dealings, make that rarer than two equal 64-bit hashes (`dealings`). Sets so small that similar ones
   differ in one token only index the combination of all their tokens and those that leave one out.
3. Pairs are filtered by length and by parity bitmaps, whose Hamming distance never exceeds the symmetric difference.
   Combinations of more than `rare` classes are cut into blocks of about `_BLOCK` members that meet pairwise as rows; each
   pair of blocks compares bitmaps and passes on a spanning forest, never all pairs.
4. The connected groups of that candidate graph meet with their sets, in parts of bounded size; pairs not yet linked
   are verified exactly. Links of one group need no more than a spanning forest to give the components.

A token or combination that a task finds in more than `rare` classes is known to be frequent there and then: it sends
just enough rows to tell the others, so no key gathers more than a few rows a task.

Tokens and classes are 64-bit hashes. Defined results: no words or null text give an empty set, linked with nothing;
fewer than k words are one shingle; repeated rows link like any copies; rows without an id keep their place in the
result; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.components import components
from siltstone.llm.tables import partitions, stored
from siltstone.llm.text import BASE, as_bytes, blocks, mix, runs, word_hashes

_PART_BYTES = 24 << 20
_SEEN = 500_000
_BLOCK = 4096
_MARKS = 1 << 27
_SHORT = np.uint64(16)


def shingle_sets(blobs: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    words, owner = word_hashes(blobs)
    at = np.searchsorted(owner, np.arange(len(blobs) + 1))
    if len(words) >= k:
        grams = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            grams = grams * np.uint64(BASE) + words[j : len(words) - k + 1 + j]
        grams = mix(grams)
    else:
        grams = words[:0]
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e - s >= k:
            out.append(np.unique(grams[s : e - k + 1]))
        elif e > s:
            h = e - s
            for w in words[s:e].tolist():
                h = (h * BASE + w) % (1 << 64)
            out.append(mix(np.array([h], dtype=np.uint64)))
        else:
            out.append(words[:0])
    return out


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit key of a set."""
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of 1024 bits or, for larger sets, the power of two above the size."""
    bits = max(1024, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, larger ones folded to the smallest size (parities add up)."""
    least = min(map(len, maps))
    return np.array([np.bitwise_xor.reduce(np.frombuffer(m, dtype=np.uint64).reshape(-1, least // 8), axis=0) for m in maps])


def compatible(n1, n2, distance, num: int, den: int):
    """False where sizes or bitmap distance rule out similarity num / den: |x ^ y| <= (n1 + n2)(den - num)/(den + num)."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (small * den >= large * num) & (distance * (den + num) <= (n1 + n2) * (den - num))


def lacking(n: int, num: int, den: int) -> int:
    """Most tokens of a set of size n that a similar one can lack."""
    return n + (-n * num) // den


def window(n: int, num: int, den: int) -> int:
    """Size of the extended prefix."""
    t = lacking(n, num, den)
    return min(n, t + 1 + max(1, t // 2))


def reach(n: int, num: int, den: int) -> int:
    """Least number of prefix tokens that a set of size n shares with a similar one, of whatever size."""
    least = -(-n * num // den)
    return window(least, num, den) - lacking(least, num, den)


def differing(n: int, num: int, den: int) -> int:
    """Most tokens in which a set of size n and a similar one differ, both sides together."""
    return n * (den - num) // num


def smallest_sets(num: int, den: int) -> int:
    """Largest size at which similar sets differ in one token at most."""
    return (2 * num - 1) // (den - num)


@lru_cache(maxsize=None)
def dealings(level: int, num: int, den: int) -> tuple[int, int]:
    """Number of ranges and of independent dealings at a level, such that the chance of a set without enough non-empty
    ranges in any of them is below 2 ** -60."""
    base = den / num
    low, high = max(smallest_sets(num, den) + 1, math.ceil(base ** (level - 1) - 1e-6)), math.floor(base ** (level + 1) + 1e-6) + 1
    most = max(differing(high, num, den), 2)
    d = np.arange(max(differing(low, num, den), 1), most + 1)
    n = np.maximum(low, -(-d * num // (den - num)))  # the smallest set that may differ in d tokens

    def bits(m: int) -> float:
        """-log2 of a bound of the chance that n tokens leave all but d of m ranges empty."""
        ways = np.array([math.lgamma(m + 1) - math.lgamma(x + 1) - math.lgamma(m - x + 1) for x in d.tolist()])
        return float(-(ways + n * np.log(d / m)).max() / math.log(2))

    largest = most + most // 2 + 8
    few, many = most + 2, largest
    if bits(largest) < 60:
        return largest, math.ceil(60 / max(bits(largest), 1.0))
    while few < many:  # more ranges make it less likely
        mid = (few + many) // 2
        few, many = (few, mid) if bits(mid) >= 60 else (mid + 1, many)
    return few, 1


def combinations(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's token combinations."""
    n, small = len(s), smallest_sets(num, den)
    keys = []
    if n <= small + 1:
        h = mix(s)
        whole = h.sum(dtype=np.uint64)
        keys.append(mix(np.r_[whole, whole - h] + np.r_[np.uint64(n), np.full(n, n - 1, dtype=np.uint64)]))
    if n > small:
        level = math.floor(math.log(n) / math.log(den / num) + 1e-9)
        for lv in (level, level + 1):
            m, times = dealings(lv, num, den)
            for k in range(times):
                own = np.sort(mix(s + np.uint64(k))) if k else s
                at = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                starts, _ = runs(at)
                keys.append(mix(np.add.reduceat(mix(own ^ np.uint64(lv * 16 + k + 1)), starts) + at[starts]))
    return np.concatenate(keys)


def too_many(key: np.ndarray, cls: np.ndarray, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (key, cls): is the key held by more than `rare` classes, and is the row beyond the first of those?"""
    new = np.r_[True, key[1:] != key[:-1]]
    fresh = new | np.r_[True, cls[1:] != cls[:-1]]
    first = np.flatnonzero(new)
    place = np.cumsum(fresh) - 1
    rank = place - np.repeat(place[first], np.diff(np.r_[first, len(key)]))  # of the class within its key
    frequent = np.repeat(np.maximum.reduceat(rank, first) >= rare, np.diff(np.r_[first, len(key)]))
    return frequent, frequent & (rank > rare)


class Frequent:
    """Keys that a task knows to be frequent; it may forget some, which costs rows only."""

    def __init__(self, rare: int, most: int = 200_000):
        self.rare, self.most, self.keys = rare, most, np.zeros(0, dtype=np.int64)

    def beyond(self, key: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """True for rows whose key is known to be frequent and has sent enough rows to tell so."""
        if not len(key):
            return np.zeros(0, dtype=bool)
        at = np.lexsort((cls, key))
        frequent, extra = too_many(key[at], cls[at], self.rare)
        out = np.empty(len(key), dtype=bool)
        out[at] = extra | np.isin(key[at], self.keys)
        found = np.union1d(self.keys, key[at][frequent])
        self.keys = found if len(found) <= self.most else np.unique(key[at][frequent])[: self.most]
        return out


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, rare: int) -> DataFrame:
    """One row per document: id, n, cls, bits, prefix (48-bit keys of its extended prefix), frequent (how many tokens of
    it are left out there, being known to be frequent).

    Copies that a task has met before (it remembers up to `_SEEN` classes) leave out what is indexed, so a class that
    holds a third of all rows reaches an index bucket at most a few times a task. Short keys only add candidates.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        known = Frequent(rare)
        for pdf in batches:
            raw, ids = [as_bytes(t) for t in pdf["text"]], pdf["id"].to_numpy()
            for s, e in blocks(raw):
                rows, heads = [], {}
                for i, x in zip(ids[s:e], shingle_sets(raw[s:e], k), strict=True):
                    n = len(x)
                    cls = class_of(x) if n else None
                    rows.append([i, n, cls, None, None, 0])
                    if cls is None or cls in seen or not differing(n, num, den):  # met before, or no other set is similar
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(cls)
                    rows[-1][3] = bitmap(x)
                    heads[len(rows) - 1] = (x[: window(n, num, den)] >> _SHORT).view(np.int64)
                if heads:
                    sizes = [len(h) for h in heads.values()]
                    beyond = known.beyond(np.concatenate(list(heads.values())), np.repeat([rows[r][2] for r in heads], sizes))
                    for (r, h), out in zip(heads.items(), np.split(beyond, np.cumsum(sizes)[:-1]), strict=True):
                        rows[r][4], rows[r][5] = h[~out], int(out.sum())
                names = ["id", "n", "cls", "bits", "prefix", "frequent"]
                cols = dict(zip(names, zip(*rows, strict=True), strict=True))
                yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "cls" else pd.Series(v, dtype=object if c in ("id", "bits", "prefix") else None) for c, v in cols.items()})  # class keys never pass through floats

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, n int, cls long, bits binary, prefix array<long>, frequent int")


def combination_rows(df: DataFrame, text_col: str, k: int, num: int, den: int, rare: int, flagged) -> DataFrame:
    """(key, cls, n, known) of the token combinations of all classes that `flagged` marks; known: the key is frequent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        known = Frequent(rare)
        for pdf in batches:
            raw = [as_bytes(t) for t in pdf["text"]]
            for s, e in blocks(raw):
                keys, classes, sizes = [], [], []
                own = [x for x in shingle_sets(raw[s:e], k) if differing(len(x), num, den)]
                cls = np.array([class_of(x) for x in own], dtype=np.int64)
                for c, x, wanted in zip(cls.tolist(), own, flagged(cls), strict=True):
                    if not wanted or c in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(c)
                    keys.append((combinations(x, num, den) >> _SHORT).view(np.int64))
                    classes.append(c)
                    sizes.append(len(x))
                if keys:
                    many = [len(x) for x in keys]
                    key, of, n = np.concatenate(keys), np.repeat(classes, many), np.repeat(sizes, many)
                    yield pd.DataFrame({"key": key, "cls": of, "n": n.astype(np.int32), "known": known.beyond(key, of)})

    return df.select(F.col(text_col).alias("text")).mapInPandas(run, "key long, cls long, n int, known boolean")


def bucket_pairs(rows: DataFrame, rare: int, num: int, den: int) -> DataFrame:
    """From (key, cls, n): kind 0 rows are pairs (a, b) of small buckets, kind 1 rows members (key, cls, n) of large ones.

    Rows are dealt by key and sorted, so buckets stream by in runs; at most `rare` members of a bucket wait for more,
    those of a larger one are passed on as they come.
    """

    def emit(key: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        starts, size = runs(key)
        a, b = [], []
        for g in np.unique(size[(size > 1) & (size <= rare)]).tolist():
            rows_at = starts[size == g][:, None] + np.arange(g)
            i, j = np.triu_indices(g, 1)
            x, y = rows_at[:, i].ravel(), rows_at[:, j].ravel()
            nx, ny = n[x].astype(np.int64), n[y].astype(np.int64)
            near = np.minimum(nx, ny) * den >= np.maximum(nx, ny) * num
            a.append(cls[x[near]])
            b.append(cls[y[near]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), dtype=np.int64)
        pairs = np.sort(pairs, axis=1)
        big = np.repeat(size > rare, size)
        kinds = np.r_[np.zeros(len(pairs), dtype=np.int32), np.ones(int(big.sum()), dtype=np.int32)]
        return pd.DataFrame({"kind": kinds, "a": np.r_[pairs[:, 0], key[big]], "b": np.r_[pairs[:, 1], cls[big]], "n": np.r_[np.zeros(len(pairs), dtype=np.int32), n[big]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        large: tuple[int, int] | None = None  # key and last class of a large bucket that may go on
        for pdf in batches:
            cols = [pdf[c].to_numpy() for c in ("key", "cls", "n")]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])]
            if large == (cols[0][0], cols[1][0]):
                new[0] = False
            cols, held = [c[new] for c in cols], []
            if large is not None:
                stop = int(np.searchsorted(cols[0], large[0], side="right"))
                if stop:
                    yield pd.DataFrame({"kind": np.ones(stop, dtype=np.int32), "a": cols[0][:stop], "b": cols[1][:stop], "n": cols[2][:stop]})
                    large = (large[0], cols[1][stop - 1])
                cols = [c[stop:] for c in cols]
                if not len(cols[0]):
                    continue
                large = None
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on in the next batch
            if len(cols[0]) - cut > rare:
                large, cut = (cols[0][-1], cols[1][-1]), len(cols[0])
            if cut:
                yield emit(*[c[:cut] for c in cols])
            held = [c[cut:] for c in cols] if cut < len(cols[0]) else []
        if held:
            yield emit(*held)

    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "cls").mapInPandas(run, "kind int, a long, b long, n int")


def in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with block and blocks: rows of equal keys are dealt to blocks of about `_BLOCK` by their class."""
    large = rows.groupBy(*keys).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = rows.join(large, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return dealt.withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))


def met_all(members: DataFrame) -> DataFrame:
    """(key, p, q, cls, side): all members (key, cls) of large buckets by block pair, with side 0 everywhere where a block meets itself."""
    rows = in_blocks(members.select("key", "cls"), ["key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "cls", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))


def marker(classes: DataFrame):
    """A filter of arrays of classes: true for all given classes and for a few others, which only adds candidates.

    The classes are folded into a bit map of 16 bits or more a class, at most `_MARKS` bits (16 MB), instead of joined: a
    join would deal out all texts once more. Beyond some 2 ** 27 classes it lets more and more others pass, and costs rows.
    """
    count = classes.count()
    size = min(_MARKS, max(1 << 20, 1 << (16 * count).bit_length()))
    words = classes.selectExpr(f"pmod(cls, {size}) div 64 as w", f"shiftleft(1L, cast(pmod(cls, {size}) % 64 as int)) as bit")
    bits = np.zeros(size // 64, dtype=np.int64)
    for r in words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[r["w"]] = r["bits"]

    def marked(cls: np.ndarray) -> np.ndarray:
        p = cls % size
        return (bits[p // 64] >> (p % 64)) & 1 == 1

    return marked


def forest_of(cls: np.ndarray, n: np.ndarray, maps: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the compatible pairs among the members of one bucket (bitmaps only). With `side`, only pairs across count."""
    order = np.argsort(n, kind="stable")
    cls, n, maps = cls[order], n[order].astype(np.int64), maps[order]
    side = None if side is None else side[order]
    label, out = np.arange(len(cls)), []
    for i in range(1, len(cls)):
        lo = int(np.searchsorted(n[:i], -(-n[i] * num // den)))
        while True:
            apart = label[lo:i] != label[i]
            left = lo + np.flatnonzero(apart if side is None else apart & (side[lo:i] != side[i]))
            if not len(left):
                break
            distance = np.bitwise_count(maps[left] ^ maps[i]).sum(axis=1, dtype=np.int64)
            near = left[compatible(n[left], n[i], distance, num, den)]
            if not len(near):
                break
            for j in near[np.unique(label[near], return_index=True)[1]].tolist():
                out.append((int(cls[j]), int(cls[i])))
                low, high = sorted((int(label[j]), int(label[i])))
                label[label == high] = low
            break
    return out


def verify(cls: np.ndarray, sets: list[np.ndarray], maps: np.ndarray, num: int, den: int, left: int | None = None) -> list[tuple[int, int]]:
    """Exactly verified links among the sets, as a spanning forest. With `left`, only pairs across that position count."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    label, out = np.arange(len(cls)), []
    for i in range(len(cls)):
        stop = i if left is None else min(i, left) if i >= left else 0
        if not stop:
            continue
        rest = np.flatnonzero(label[:stop] != label[i])
        if not len(rest):
            continue
        distance = np.bitwise_count(maps[rest] ^ maps[i]).sum(axis=1, dtype=np.int64)
        for j in rest[compatible(n[rest], n[i], distance, num, den)].tolist():
            if label[j] == label[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * shared >= num * (n[i] + n[j] - shared):
                out.append((int(cls[j]), int(cls[i])))
                low, high = sorted((int(label[j]), int(label[i])))
                label[label == high] = low
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, rare: int = 16) -> DataFrame:
    """id, n_shingles and component_id (smallest id reachable by links of Jaccard similarity num / den or more) of every row."""
    sig = stored(signatures(df, id_col, text_col, k, num, den, rare), "signatures")
    by_class = sig.where("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    indexed = sig.where("prefix is not null")

    singles = indexed.select(F.explode("prefix").alias("key"), "cls", "n")
    found = stored(bucket_pairs(singles, rare, num, den), "single-buckets")
    in_buckets = found.where("kind = 1").groupBy(F.col("b").alias("cls")).agg(F.count("*").alias("here"))
    left_out = indexed.groupBy("cls").agg(F.max("frequent").alias("frequent"), F.first("n").alias("n"))
    least = f"ceil(n * {num}L / {den})"
    t = f"({least} + floor(-{least} * {num}L / {den}))"
    enough = f"frequent + coalesce(here, 0) >= least({least} - {t}, 1 + greatest(1, {t} div 2))"  # reach(n)
    flagged = marker(left_out.join(in_buckets, "cls", "left").where(enough).select("cls"))
    combos = stored(combination_rows(df, text_col, k, num, den, rare, flagged), "combinations")
    combined = stored(bucket_pairs(combos.where("not known").drop("known"), rare, num, den), "combination-buckets")
    combined = combined.unionByName(combos.where("known").selectExpr("1 as kind", "key as a", "cls as b", "n"))

    bits = indexed.groupBy("cls").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    pairs = found.where("kind = 0").unionByName(combined.where("kind = 0")).select("a", "b").distinct()
    left = bits.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = bits.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = np.zeros(len(pdf), dtype=bool)
            for x in np.unique([len(b) for b in pdf["ba"]]).tolist():
                for y in np.unique([len(b) for b in pdf["bb"]]).tolist():
                    at = np.flatnonzero(((pdf["ba"].str.len() == x) & (pdf["bb"].str.len() == y)).to_numpy())
                    if len(at):
                        both = folded([*pdf["ba"].iloc[at], *pdf["bb"].iloc[at]])
                        distance = np.bitwise_count(both[: len(at)] ^ both[len(at) :]).sum(axis=1, dtype=np.int64)
                        keep[at] = compatible(pdf["na"].to_numpy()[at].astype(np.int64), pdf["nb"].to_numpy()[at].astype(np.int64), distance, num, den)
            yield pdf.loc[keep, ["a", "b"]]

    screened = pairs.join(left, "a").join(right, "b").mapInPandas(screen, "a long, b long")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        edges = forest_of(pdf["cls"].to_numpy(), pdf["n"].to_numpy(), folded(list(pdf["bits"])), num, den, side if side.any() else None)
        return pd.DataFrame([e for e in edges if e[0] != e[1]], columns=["a", "b"]).astype("int64")

    large = met_all(combined.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("cls")).distinct())
    forests = large.join(bits, "cls").groupBy("key", "p", "q").applyInPandas(forest, "a long, b long")
    candidates = stored(screened.unionByName(forests).distinct(), "candidates")

    groups = components(candidates, "candidate-groups")
    members = groups.join(by_class, groups["v"] == by_class["cls"]).select("label", "cls", "rep", "n")
    weight = members.groupBy("label").agg(F.ceil(F.sum(F.col("n").cast("long") * 8) / _PART_BYTES).cast("int").alias("parts"))
    members = stored(members.join(weight, "label").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")), "members")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [as_bytes(t) for t in pdf["text"]]
            for s, e in blocks(raw):
                part = pdf.iloc[s:e].drop(columns="text")
                own = shingle_sets(raw[s:e], k)
                same = np.array([len(x) > 0 and class_of(x) == c for x, c in zip(own, part["cls"], strict=True)], dtype=bool)
                yield part.assign(tokens=[x.tobytes() for x in own])[same]

    texts = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    with_sets = texts.join(members.select("rep", "label", "part", "parts", "cls"), "rep").select("label", "part", "parts", "cls", "text")
    with_sets = with_sets.mapInPandas(sets, "label long, part int, parts int, cls long, tokens binary")
    # groups of several parts: each pair of parts meets once; all others are one part alone
    meets = with_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = meets.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})

    def check(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("cls").sort_values(["part", "cls"])
        own = [np.frombuffer(t, dtype=np.uint64) for t in pdf["tokens"]]
        cut = None if key[1] == key[2] else int((pdf["part"] == key[1]).sum())
        edges = verify(pdf["cls"].to_numpy(), own, folded([bitmap(s) for s in own]), num, den, cut)
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    links = stored(meets.select("label", "p", "q", "part", "cls", "tokens").groupBy("label", "p", "q").applyInPandas(check, "a long, b long"), "links")
    linked = components(links, "linked-classes")
    firsts = linked.join(by_class, linked["v"] == by_class["cls"]).groupBy("label").agg(F.min("rep").alias("first"))
    component = by_class.join(linked, by_class["cls"] == linked["v"], "left").join(firsts, "label", "left").select("cls", F.coalesce("first", "rep").alias("first"))
    out = sig.select("id", "n", "cls").join(component, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("first", "id").alias("component_id"))
