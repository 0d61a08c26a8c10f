import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siltstone.llm import topk
from siltstone.llm.queries import op10_exact_top_k


def brute(rows, k=10):
    ok = [(i, np.floor(np.array(v, dtype=np.float64) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.r_[v, np.zeros(d - len(v), dtype=np.int64)]) for i, v in ok]
    out = set()
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def test_query_equals_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    want = brute(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)))
    assert {tuple(r) for r in op10_exact_top_k(spark, "/root/testdata/sf0.01").collect()} == want


@pytest.mark.parametrize("block", [7, 10_000])
def test_odd_vectors_ties_and_many_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * (5 if i % 7 else 40)).tolist()) for i in range(230)]
    rows += [(300 + i, rows[3][1]) for i in range(40)]
    rows += [(400, None), (500, [1.0, None]), (600, [float("nan")] * 6), (700, [float("inf")]), (800, [2.0, -1.0]), (900, []), (1000, [0.0] * 6), (1100, [3e6] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block=block, query_block=3)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (100, 101)"), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(100, 1, 101)]
