import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from siltstone.llm import resampling
from siltstone.llm.queries import OP12_SQL, op12_target_resampling


def runs(text, longest=2):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets=10_000, longest=2, percent=25, least=20):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for x in texts for f in runs(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    rows = []
    for i, x in docs:
        w, fs = runs(x, longest)
        weight = math.floor(Fraction(sum(gain[of(f)] for f in fs), len(fs))) if fs else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(fs), weight, score, None, len(w)])
    may = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.001"
    t, b = pq.read_table(f"{sf}/documents.parquet"), pq.read_table(f"{sf}/benchmark.parquet")
    found = got(op12_target_resampling(spark, sf))
    assert found == brute(list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True)), b["text"].to_pylist())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert sorted(con.execute(OP12_SQL).fetchall(), key=str) == found


@pytest.mark.parametrize(("longest", "group_bytes"), [(1, 1 << 23), (2, 40), (3, 200)])
def test_odd_texts_and_salted_groups(spark, longest, group_bytes):
    rng = np.random.default_rng(2)
    pool = ["the", "The", "ΑΒΓ", "naïve", "x1", "9", "a\0b", "𝄞", "w" * 90]
    texts = [None, "", "...", "one", "\x7f`{@", " ".join(["same word here"] * 9)] + [" ".join(rng.choice(pool, rng.integers(1, 60))) for _ in range(80)]
    docs = list(enumerate(texts)) + [(3, "another text with an old id " * 5), (7, texts[7]), (7, texts[7]), (None, texts[8]), (None, texts[8])]
    target = ["the x1 naïve the", None, "", "unseen words only"]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4.0) for i, t in docs], "doc_id long, text string, row int, id int, n int, score double").repartition(6)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    assert got(resampling.resample(df, aim, longest=longest, group_bytes=group_bytes)) == brute(docs, target, longest=longest)
    assert got(resampling.resample(df, aim.limit(0), longest=longest)) == brute(docs, [], longest=longest)
    assert got(resampling.resample(df.limit(0), aim, longest=longest)) == []


def test_long_texts_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(4)
    text = b" .".join(rng.choice([b"a", b"bc", b"the", b"d" * 70, b"e1"], 900).tolist()) + b"." * 50 + b"end"
    whole = resampling.features([text], 97, 2)
    cut = list(resampling.pieces(text, 100))
    assert len(cut) > 20 and b"".join(cut) == text
    monkeypatch.setattr(resampling, "pieces", lambda raw: cut)
    monkeypatch.setattr(resampling, "LONG_TEXT", 10)
    for a, b in zip(whole, resampling.folded([text], 97, 2), strict=True):
        assert np.array_equal(a, b)


def test_packed_postings_come_back():
    rng = np.random.default_rng(5)
    key = np.unique(rng.integers(0, 10**7, 5000))
    count = rng.choice([1, 2, 254, 255, 256, 10**9], len(key))
    back = resampling.unpacked(resampling.packed(key, count))
    assert np.array_equal(back[0], key) and np.array_equal(back[1], count)
    assert [len(x) for x in resampling.unpacked(resampling.packed(key[:0], count[:0]))] == [0, 0]
