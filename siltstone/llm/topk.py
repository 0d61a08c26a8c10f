"""Exact top-k by inner product: vectors in descending length, rotated partial sums, Cauchy-Schwarz pruning.

Vectors are quantised to integers floor(scale * x); scores are integer inner products, so results are exact. The Gram
matrix of all vectors (d x d, summed by the tasks) gives a rotation that puts most of the length into the first
coordinates; a candidate's score is at most its partial sum over those plus the product of the residual lengths.

Candidates are ranged by length into blocks of about `block` rows; queries are dealt into blocks of at most
`query_block` rows. A first pass meets every query block with the longest candidate block only and leaves each query a
threshold, its k-th score so far; the second meets the other blocks, skips those whose longest vector cannot reach the
threshold, and prunes inside a block. Only the k best of each query and block go on to the final ranking.

Defined results: null vectors and those holding null or non-finite components take no part, nor do rows without an id;
missing components of shorter vectors count as 0; repeated ids are candidates of their own (a query's own id never is);
ties go to the smaller id; fewer candidates than k give all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tables import stored

_OUT = "query_id long, vec_id long, score long"


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (array of integers) of the rows that take part."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(vs, dims: int) -> np.ndarray:
    out = np.zeros((len(vs), dims), dtype=np.int64)
    for k, v in enumerate(vs):
        out[k, : len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a with the rows of b."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:  # every partial sum is a whole number that doubles hold exactly
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)  # raises where a score is no long


def gram(rows: DataFrame, dims: int) -> np.ndarray:
    """Sum of the outer products of all vectors; each task sends one d x d matrix, added up by rows of the matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for pdf in batches:
            x = matrix(pdf["v"], dims).astype(np.float64)
            total += x.T @ x
        yield pd.DataFrame({"i": range(dims), "row": list(total)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "row": [np.sum(list(pdf["row"]), axis=0)]})

    sent = rows.select("v").mapInPandas(run, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    out = np.zeros((dims, dims))
    for r in sent.collect():  # d rows of d numbers
        out[r["i"]] = r["row"]
    return out


def best_of(q_id, q, floor, c_id, c, rotation: np.ndarray, k: int, head: int) -> pd.DataFrame:
    """The k best candidates of each query within one block; candidates in descending length. floor: a score known to be reached."""
    rq, rc = q @ rotation, c @ rotation
    q_rest = np.sqrt((rq[:, head:] ** 2).sum(axis=1))
    c_rest = np.sqrt((rc[:, head:] ** 2).sum(axis=1))
    q_len, c_len = np.sqrt((rq**2).sum(axis=1)), np.sqrt((rc**2).sum(axis=1))
    rows = []
    for i in range(len(q_id)):
        need = floor[i]
        slack = 1e-9 * (q_len[i] * (c_len[0] if len(c_len) else 0) + 1)  # rounding of the bounds only
        got_id, got = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, step = 0, 512
        while at < len(c_id):
            stop = min(at + step, len(c_id))
            if q_len[i] * c_len[at] + slack < need:
                break  # every later vector is shorter still
            bound = rc[at:stop, :head] @ rq[i, :head] + c_rest[at:stop] * q_rest[i]
            left = at + np.flatnonzero((bound + slack >= need) & (c_id[at:stop] != q_id[i]))
            if len(left):
                got_id, got = np.r_[got_id, c_id[left]], np.r_[got, products(q[i : i + 1], c[left])[0]]
                order = np.lexsort((got_id, -got))[:k]
                got_id, got = got_id[order], got[order]
                if len(got) == k:
                    need = max(need, float(got[-1]))
            at, step = stop, min(2 * step, 8192)
        rows.append((np.full(len(got), q_id[i]), got_id, got))
    cat = [np.concatenate(x) if rows else np.zeros(0, dtype=np.int64) for x in zip(*rows, strict=True)] or [np.zeros(0, dtype=np.int64)] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cat, strict=True)))


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row where is_query holds, itself left out."""
    spark = df.sparkSession
    source = df.select(F.col(id_col), F.col(vec_col), is_query.alias("is_query"))
    rows = usable(source, id_col, vec_col, scale).withColumn("len", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = usable(source.where("is_query"), id_col, vec_col, scale)
    sizes = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    asks = asked.count()
    if not sizes["n"] or not asks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(int(sizes["d"]), 1)
    values, axes = np.linalg.eigh(gram(rows, dims))
    rotation = axes[:, np.argsort(-values)]
    share = np.cumsum(np.sort(values)[::-1]) / max(values.sum(), 1e-9)
    head = min(int(np.searchsorted(share, 0.7)) + 1, dims)

    # blocks of falling length: quantiles of the length over all rows; equal lengths may share a block
    many = max(1, round(sizes["n"] / block))
    cuts = sorted(set(rows.approxQuantile("len", [i / many for i in range(1, many)], 0.1 / many))) if many > 1 else []
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else None
    place = F.size(F.filter(edges, lambda e: e > F.col("len"))) if cuts else F.lit(0)
    # ties of one length can fill a block without bound: a salt splits every block into parts of about `block` rows
    parts = rows.withColumn("block", place)
    per = {r["block"]: max(1, round(r["n"] / block)) for r in parts.groupBy("block").agg(F.count("*").alias("n")).collect()}
    salts = F.create_map(*[F.lit(x) for b, s in per.items() for x in (b, s)])
    parts = parts.withColumn("part", F.pmod(F.xxhash64("id"), salts[F.col("block")]).cast("int"))
    first_block = min(per)

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix(pdf["v"], dims)
        order = np.argsort(-(m.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        longest = float(np.sqrt((m[order[0]].astype(np.float64) ** 2).sum()))
        return pd.DataFrame({"block": [key[0]], "part": [key[1]], "longest": [longest], "ids": [pdf["id"].to_numpy()[order].tobytes()], "vs": [m[order].tobytes()]})

    packed = stored(parts.select("block", "part", "id", "v").groupBy("block", "part").applyInPandas(gather, "block int, part int, longest double, ids binary, vs binary"), "topk-blocks")
    q_blocks = -(-asks // query_block)

    def gather_q(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in range(0, len(pdf), query_block):
            p = pdf.iloc[s : s + query_block]
            out.append((key[0], p["id"].to_numpy().tobytes(), matrix(p["v"], dims).tobytes()))
        return pd.DataFrame(out, columns=["qb", "q_ids", "qs"])

    queries = asked.distinct().withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int")).groupBy("qb").applyInPandas(gather_q, "qb int, q_ids binary, qs binary")
    queries = stored(queries, "topk-queries")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q_id, q = np.frombuffer(r.q_ids, dtype=np.int64), np.frombuffer(r.qs, dtype=np.int64).reshape(-1, dims)
                c_id, c = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.vs, dtype=np.int64).reshape(-1, dims)
                floor = np.full(len(q_id), -np.inf)
                if r.floors is not None:
                    known = dict(zip(np.frombuffer(r.floor_ids, dtype=np.int64).tolist(), np.frombuffer(r.floors, dtype=np.float64).tolist(), strict=True))
                    floor = np.array([known.get(x, -np.inf) for x in q_id.tolist()])
                near = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * r.longest * (1 + 1e-9) + 1 >= floor
                if near.any():
                    yield best_of(q_id[near], q[near], floor[near], c_id, c, rotation, k, head)

    def pairs(blocks: DataFrame, asking: DataFrame) -> DataFrame:
        """Every candidate block beside every query block: an equi-join on the query block's number."""
        dealt = blocks.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        return dealt.repartition(F.col("qb"), F.col("block"), F.col("part")).join(asking, "qb").select("ids", "vs", "longest", "q_ids", "qs", "floor_ids", "floors")

    none = queries.withColumn("floor_ids", F.lit(None).cast("binary")).withColumn("floors", F.lit(None).cast("binary"))
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    first = stored(ranked(pairs(packed.where(F.col("block") == first_block), none).mapInPandas(meet, _OUT)), "topk-first")
    rest = packed.where(F.col("block") != first_block)

    def pack_floors(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"qb": [key[0]], "floor_ids": [pdf["query_id"].to_numpy().tobytes()], "floors": [pdf["score"].to_numpy(dtype=np.float64).tobytes()]})

    floors = first.where(F.col("rank") == k).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).select("qb", "query_id", "score")
    floors = floors.groupBy("qb").applyInPandas(pack_floors, "qb int, floor_ids binary, floors binary")
    second = pairs(rest, queries.join(floors, "qb", "left")).mapInPandas(meet, _OUT)
    return ranked(first.select("query_id", "vec_id", "score").unionByName(second)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
