"""Exact integer k-means by partial-distance search.

Vectors become integers floor(scale * x). Dimensions are taken in the order of falling variance, which one pass over all
vectors measures; the squared differences to a centroid are added up some dimensions at a time, and the centroid is given
up for every vector whose sum is strictly above its best distance so far. Survivors finish all dimensions, so distances
and ties are exact. Tasks send one sum and one count for each cluster and dimension; only k x dims numbers reach the
driver. Every pass is a map over the source, so a lost executor repeats its own part.

Defined results: vectors that are null, of another length, or hold null, non-finite or huge (2**62 and more after scaling)
components take no part; repeated rows count as often as they stand; centroids start in the order of the ids' hashes, equal
ids by their components, rows without an id last; fewer vectors than k give as many centroids; ties go to the smaller
number; a distance or sum that is no long is null; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tables import stored

HUGE = 2**62
LONG = 2**63


def quantised(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer components of the batch's vectors that take part; columns id, v (array of doubles)."""
    whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column("v")), dims), False)
    part = batch.filter(whole)
    with np.errstate(invalid="ignore", over="ignore"):
        q = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * scale)
        fine = (np.abs(q) < HUGE).all(axis=1)  # false for nulls, which are NaN here
    return part.column("id").filter(pa.array(fine)), q[fine].astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of every row; `order`: dimensions, those of high variance first."""
    x, c = x[:, order], centroids[:, order]
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    if reach * reach * x.shape[1] >= LONG:  # int64 would overflow: whole numbers of any size instead
        x, c = x.astype(object), c.astype(object)
    parts = [np.ascontiguousarray(x[:, s : s + step]) for s in range(0, x.shape[1], step)]
    best = ((x - c[0]) ** 2).sum(axis=1)
    who = np.zeros(len(x), dtype=np.int32)
    for k in range(1, len(c)):
        alive, far = np.arange(len(x)), np.zeros(len(x), dtype=x.dtype)
        for i, p in enumerate(parts):
            far = far + ((p[alive] - c[k, i * step : (i + 1) * step]) ** 2).sum(axis=1)
            stay = far <= best[alive]
            alive, far = alive[stay], far[stay]
            if not len(alive):
                break
        won = far < best[alive]
        best[alive[won]], who[alive[won]] = far[won], k
    return who, best


def by_variance(rows: DataFrame, dims: int, scale: int) -> np.ndarray:
    """Dimensions in the order of falling variance over all vectors; it decides the work, never the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            x = quantised(batch, dims, scale)[1].astype(np.float64)
            n, s, ss = n + len(x), s + x.sum(axis=0), ss + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), pa.int32()), "n": [n] * dims, "s": s, "ss": ss})

    sums = rows.mapInArrow(run, "dim int, n long, s double, ss double").groupBy("dim").agg(F.sum("n"), F.sum("s"), F.sum("ss"))
    spread = np.zeros(dims)
    for dim, n, s, ss in sums.collect():  # one row for each dimension
        spread[dim] = ss / n - (s / n) ** 2 if n else 0
    return np.argsort(-spread, kind="stable")


def first_centroids(rows: DataFrame, dims: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hashes of `<seed>:<id>`."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float(HUGE)))
    found = rows.where(fine & (F.size("v") == dims)).withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    top = found.orderBy(F.asc_nulls_last("h"), "v").limit(k).select("v").collect()
    return np.floor(np.array([r["v"] for r in top], dtype=np.float64).reshape(-1, dims) * scale).astype(np.int64)


def moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray, scale: int) -> np.ndarray:
    """Centroids after one round: componentwise floors of the means; empty clusters keep theirs."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=object)
        for batch in batches:
            x = quantised(batch, dims, scale)[1]
            if not len(x):
                continue
            who = nearest(x, centroids, order)[0]
            exact = x if int(np.abs(x).max()) * len(x) < LONG else x.astype(object)
            for c in np.unique(who):
                mine = exact[who == c]
                count[c] += len(mine)
                total[c] += mine.sum(axis=0).astype(object)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict(
            {
                "cluster": pa.array(np.repeat(full, dims), pa.int32()),
                "dim": pa.array(np.tile(np.arange(dims), len(full)), pa.int32()),
                "n": pa.array(np.repeat(count[full], dims), pa.int64()),
                "total": pa.array([Decimal(int(v)) for v in total[full].ravel()], pa.decimal128(38, 0)),
            }
        )

    sums = rows.mapInArrow(run, "cluster int, dim int, n long, total decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = centroids.copy()
    for r in sums.collect():  # at most k x dims rows
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def k_means(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every vector, by the final centroids; the centroids)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    centroids = first_centroids(rows, dims, scale, k, seed)
    id_type = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        return df.sparkSession.createDataFrame([], f"id {id_type}, cluster int, distance long"), centroids
    order = by_variance(rows, dims, scale)
    for _ in range(rounds):
        centroids = moved(rows, centroids, order, scale)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = quantised(batch, dims, scale)
            if len(x):
                who, far = nearest(x, centroids, order)
                if far.dtype == object:
                    far = pa.array([int(d) if d < LONG else None for d in far], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(who), pa.array(far)], ["id", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), centroids


def clustered(df: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part; options as in k_means."""
    spark = df.sparkSession
    found, centroids = k_means(df, id_col, **options)
    found = stored(found, "clusters")
    spent = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r[0]: None if r[2] else int(r[1]) for r in found.groupBy("cluster").agg(spent, F.max(F.col("distance").isNull())).collect()}  # k rows
    whole = None if None in sums.values() else sum(sums.values())
    long = lambda x: x if x is not None and x < LONG else None
    about = [(c, long(s), long(whole), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    of_cluster = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    out = found.join(F.broadcast(of_cluster), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
