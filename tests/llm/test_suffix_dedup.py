import hashlib
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from siltstone.llm import suffix_dedup as sd
from siltstone.llm.queries import queries
from siltstone.llm.suffix_order import blind_trie_order, deep_shallow


def brute(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for i, raw in enumerate(raws):
        for s in range(len(raw) - length + 1):
            seen.setdefault(raw[s : s + length], []).append((i, s))
    gone = [np.zeros(len(r), dtype=bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = True
    out = []
    for i, (raw, g) in enumerate(zip(raws, gone, strict=True)):
        n = int(np.sum(np.diff(np.r_[0, g.astype(int)]) == 1))
        kept = bytes(b for b, x in zip(raw, g, strict=True) if not x)
        out.append((i, len(raw), int(g.sum()), n, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_equals_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").sort_by("doc_id")
    got = sorted(map(tuple, queries()["op3_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()))
    assert got == brute(t.column("text").to_pylist(), 200)
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize(("length", "per_task"), [(20, 40_000), (20, 3), (50, 40_000), (50, 5)])
def test_planted_repeats(spark, length, per_task):
    rng = random.Random(length)
    passage = "".join(rng.choice("abcdé ") for _ in range(120))
    texts = [None, "", "short", "x" * 300, "x" * 19, "ab" * 100, "\0" * 90, "\0" * 25 + "q"]
    for _ in range(60):
        s, e = sorted((rng.randrange(120), rng.randrange(121)))
        noise = lambda: "".join(rng.choice("ab\0é") for _ in range(rng.randrange(40)))
        texts.append(noise() + passage[s:e] + noise())
    texts += texts[10:14]
    df = spark.createDataFrame([(i, t, "z", 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, uid string, spans int, `a.b` int, _of int")
    assert sorted(map(tuple, sd.digest(df, length=length, per_task=per_task).collect())) == brute(texts, length)
    left = {r.doc_id: r for r in sd.remove_repeats(df, length=length, per_task=per_task).collect()}
    assert left[0].text is None and left[3].text == "" and left[2].text == "short" and left[2].uid == "z"
    assert sd.digest(df.limit(0)).count() == 0


def test_sorting():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 41, 500)
    rows = rng.integers(97, 99, (500, 40)).astype(np.uint8)
    rows[:200, :30] = 97
    rows[np.arange(40) >= lengths[:, None]] = 0
    group = rng.integers(0, 3, 500)
    order, lcp = deep_shallow(group, rows, lengths)
    key = lambda i: (group[i], rows[i].tobytes(), lengths[i])
    assert [key(i) for i in order] == sorted(key(i) for i in range(500))
    for a, b, x in zip(order[:-1], order[1:], lcp[1:], strict=True):
        n = next((k for k in range(min(lengths[a], lengths[b])) if rows[a][k] != rows[b][k]), min(lengths[a], lengths[b]))
        assert x == (n if group[a] == group[b] else -1)
    strings = [bytes(rng.integers(0, 3, 9).astype(np.uint8)) for _ in range(400)]
    assert [strings[i] for i in blind_trie_order(strings)] == sorted(strings)


def test_one_gram_in_many_contexts(spark):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    gram, long = noise(24), noise(60)
    texts = [noise(rng.randrange(5, 12)) + gram + noise(rng.randrange(5, 12)) for _ in range(4000)]
    texts += [noise(6) + long[rng.randrange(10) : 50 + rng.randrange(10)] + noise(6) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, sd.digest(df, length=40, per_task=200).collect())) == brute(texts, 40)


def test_repeated_rows_stay_linear(spark):
    """2,000 equal rows of one text: all of them go, and each row meets its own places only."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    seconds = []
    for n in (20, 200, 2000):
        df = spark.createDataFrame([(None, text)] * n + [(1, "short"), (1, "short"), (2, "z" + text[:150])], "doc_id long, text string").repartition(8)
        start = time.time()
        got = sd.digest(df).collect()
        seconds.append(time.time() - start)
        assert len(got) == n + 3
        assert {(r.n_bytes, r.n_removed, r.n_spans) for r in got} == {(5000, 5000, 1), (5, 0, 0), (151, 0, 0)}
    assert seconds[2] < 5 * seconds[1] + 10
