import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from siltstone.llm import near_duplicates as nd
from siltstone.llm.queries import queries


def brute(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for t in s:
            holders.setdefault(t, []).append(i)
    pairs = {(a, b) for i, s in enumerate(sets) for t in s for a, b in ((i, j) for j in holders[t] if j > i)}
    for a, b in sorted(pairs):
        shared = len(sets[a] & sets[b])
        if den * shared >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return [(i, len(sets[i]), root(i)) for i in range(len(texts))]


def test_query_equals_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id")
    got = sorted(map(tuple, queries()["op7_ngram_jaccard_join"](spark, "/root/testdata/sf0.01").collect()))
    assert got == brute(t.column("text").to_pylist(), 4, 85, 100)


@pytest.mark.parametrize(("k", "num", "rare"), [(4, 85, 2), (5, 80, 3), (2, 60, 2), (1, 90, 4)])
def test_groups_with_frequent_tokens(spark, k, num, rare):
    rng = random.Random(num)
    words = [f"w{i}" for i in range(400)]
    base, passage = [rng.choice(words) for _ in range(90)], [rng.choice(words) for _ in range(40)]
    texts = [None, "", "  ", "one two", "One TWO", "one two three", "a b c d e f g", "a b c d e f g h"]
    for i in range(60):
        copy = list(base)
        for _ in range(i % 7):
            copy[rng.randrange(90)] = rng.choice(words)
        texts.append(" ".join(copy))
    for _ in range(40):
        texts.append(" ".join([*passage, *(rng.choice(words) for _ in range(rng.randrange(0, 30)))]))
    texts += texts[8:12] + ["x " * 4000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = sorted(map(tuple, nd.near_duplicates(df, k=k, num=num, rare=rare).collect()))
    assert got == brute(texts, k, num, 100)


@pytest.mark.parametrize("block", [4096, 16])
def test_short_texts_around_one_frequent_shingle(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "_BLOCK", block, raising=False)
    rng = random.Random(block)
    texts = [f"a b c d e {' '.join(str(rng.randrange(10**6)) for _ in range(3 + i % 3))}" for i in range(300)]
    texts += [f"{texts[i]} more" for i in range(0, 300, 3)] + texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, nd.near_duplicates(df, k=5, num=80, rare=3).collect())) == brute(texts, 5, 80, 100)


def test_large_buckets_emit_members_once_and_no_pairs(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(1, c, 4) for c in range(100) for _ in range(2)] + [(2, 5, 4), (2, 6, 4)] + [(3, c, 4) for c in range(20)]
        got = nd.bucket_pairs(spark.createDataFrame(rows, "key long, cls long, n int"), 16, 80, 100).select("kind", "a", "b").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [(0, 5, 6), *((1, 1, c) for c in range(100)), *((1, 3, c) for c in range(20))]


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_reach_and_dealings():
    for num in (50, 80, 85, 90):
        for n in range(1, 3000):
            least = -(-n * num // 100)
            assert nd.lacking(n, num, 100) == n - least and nd.window(n, num, 100) <= n
            assert 1 <= nd.reach(n, num, 100) <= nd.window(least, num, 100) and nd.reach(n, num, 100) <= nd.reach(n + 1, num, 100)
    rng = random.Random(5)
    for n in [*range(2, 40), 100, 500]:
        x = np.array(sorted(rng.randrange(1 << 64) for _ in range(n)), dtype=np.uint64)
        for num in (80, 85):
            for gone in range(nd.differing(n, num, 100) + 1):
                y = np.sort(np.r_[x[gone:], np.array([rng.randrange(1 << 64) for _ in range(nd.differing(n, num, 100) - gone)], dtype=np.uint64)])
                if 100 * (n - gone) >= num * (n + len(y) - n + gone) and len(y) and nd.differing(len(y), num, 100):
                    assert np.intersect1d(nd.combinations(x, num, 100), nd.combinations(y, num, 100)).size, (n, num, gone)


@pytest.mark.parametrize("most", [200_000, 3])
def test_frequent_keys_send_few_rows(most):
    known = nd.Frequent(2, most)
    key, cls = np.array([7] * 6 + [8, 8, 9]), np.array([1, 1, 2, 3, 4, 5, 1, 2, 3])
    assert known.beyond(key, cls).tolist() == [False, False, False, False, True, True, False, False, False]
    assert known.beyond(np.array([7, 9, 9]), np.array([9, 1, 2])).tolist() == [True, False, False]
