import collections
import functools
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siltstone.llm import katz
from siltstone.llm.queries import queries


def brute(rows, trained, order=3):
    """Scores by the recursive definition, and that every context's probabilities sum to one."""
    toks = [((t or "").encode().lower().split(), tr) for t, tr in zip(rows, trained, strict=True)]
    toks = [([*w, b"\n"], tr) for w, tr in toks]
    seen = [None, *(collections.Counter() for _ in range(order))]
    total, after = collections.Counter(), collections.defaultdict(set)
    for w, tr in toks:
        padded = (order - 1) * [b" "] + w
        for j in range(order - 1, len(padded) if tr else 0):
            for k in range(1, order + 1):
                g = tuple(padded[j - k + 1 : j + 1])
                seen[k][g] += 1
                if k > 1:
                    total[g[:-1]] += 1
                    after[g[:-1]].add(g[-1])
    n, v = sum(seen[1].values()), len(seen[1])
    disc = lambda c, d: d[c] * c if c < len(d) else c * c / (c + 1)
    d = [None, *(katz.discounts(collections.Counter(x.values())) for x in seen[1:])]
    p1 = {g[0]: disc(c, d[1]) / n for g, c in seen[1].items()}
    unknown = 1 - sum(p1.values()) if n else 1.0

    def p(w, h):
        if not h:
            return p1.get(w, unknown)
        c = seen[len(h) + 1][(*h, w)]
        return disc(c, d[len(h) + 1]) / total[h] if c else alpha(h) * p(w, h[1:])

    @functools.cache
    def alpha(h):
        if h not in after:
            return 1.0
        words = after[h]
        return (1 - sum(disc(seen[len(h) + 1][(*h, w)], d[len(h) + 1]) for w in words) / total[h]) / (1 - sum(p(w, h[1:]) for w in words))

    for h in list(after)[:12]:
        assert abs(sum(p(w, h) for w in p1) + p(None, h) - 1) < 1e-9
    out = []
    for w, _ in toks:
        base = sum(math.log10((seen[1][(x,)] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        padded = (order - 1) * [b" "] + w
        s = sum(math.log10(p(padded[j], tuple(padded[j - order + 1 : j]))) for j in range(order - 1, len(padded)))
        out.append((len(w), sum(seen[1][(x,)] > 0 for x in w), n, base, s))
    return out


def same(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3]
        assert np.allclose(g[3:], w[3:], rtol=1e-9, atol=1e-9)


def test_query_equals_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")
    ids = t.column("doc_id").to_pylist()
    trained = [zlib.crc32(str(i).encode()) % 10 != 0 for i in ids]
    rows = sorted(queries()["op1_katz_backoff"](spark, "/root/testdata/sf0.01").collect())
    assert [r.doc_id for r in rows] == ids and [r.held_out for r in rows] == [not x for x in trained]
    got = [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows]
    same(got, brute(t.column("text").to_pylist(), trained))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_texts_and_small_buckets(spark, order):
    texts = [None, "", "the the the a", "The a b", "zz the q", "a " * 3000, "the a b c", "x"] * 3 + ["never seen before"]
    trained = [k % 5 != 4 for k in range(len(texts))]
    df = spark.createDataFrame([(k, t, tr, 1) for k, (t, tr) in enumerate(zip(texts, trained, strict=True))], "doc_id long, text string, keep boolean, bucket int")
    out, model = katz.score(df, F.col("keep"), order=order, per_bucket=50)
    rows = sorted(out.collect())
    same([(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows], brute(texts, trained, order))
    assert model.ngrams(2).agg(F.sum("c")).first()[0] == model.uni.total and model.contexts(order).where("alpha > 0 and total > 0").count() > 1
    untrained = katz.score(df, F.lit(False))[0].collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untrained)
    assert katz.score(df.limit(0), F.col("keep"))[0].count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in katz.score(odd, F.lit(True))[0].collect()) == [("1", 3), ("1", 3), ("None", 3)]
