import hashlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
from siltstone.llm import clusters
from siltstone.llm.queries import OP11_SQL, op11_centroid_clustering


def brute(rows, k=16, dims=64, scale=64, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(float(x) * scale)) for x in v]))
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"1:{kept[j][0]}".encode()).hexdigest(), kept[j][1]))
    centroids = [kept[j][1] for j in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            groups.setdefault(n, []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    last = assign()
    inertia = {}
    for d, n in last:
        inertia[n] = inertia.get(n, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    t = pq.read_table(f"{sf}/embeddings.parquet")
    found = got(op11_centroid_clustering(spark, sf))
    assert found == brute(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(OP11_SQL).fetchall(), key=str) == found


def test_odd_vectors_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(60)] * 2
    rows += [(7, [9.0, 9.0, -9.0, 0.5]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0]), (204, [float("nan")] * 4), (205, [float("inf")] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id int, v int")
    assert got(clusters.clustered(df.repartition(5), dims=4, k=6)) == brute(rows, k=6, dims=4)
    assert got(clusters.clustered(df.limit(0), dims=4)) == []
    few = [(1, [0.5, 0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5, 0.5])]
    assert got(clusters.clustered(spark.createDataFrame(few, "vec_id long, embedding array<double>"), dims=4)) == brute(few, dims=4)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) * 2.0**28).tolist()) for i in range(50)] + [(90, [1e30] * 4)]
    found = {r["vec_id"]: r for r in clusters.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=4, k=3).collect()}
    want = {r[0]: r for r in brute(rows[:-1], k=3, dims=4)}
    assert found.keys() == want.keys()
    for i, w in want.items():
        assert (found[i]["cluster"], found[i]["centroid_sha256"]) == (w[1], w[5])
        assert found[i]["distance"] == (w[2] if w[2] < 2**63 else None)


def test_partial_distances_equal_whole_ones():
    rng = np.random.default_rng(7)
    x, c = rng.integers(-3, 4, (500, 10)), rng.integers(-3, 4, (9, 10))
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    who, far = clusters.nearest(x, c, rng.permutation(10), step=3)
    assert (who == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
