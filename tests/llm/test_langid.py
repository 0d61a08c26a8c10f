import collections
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from siltstone.llm import langid
from siltstone.llm.queries import op4_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op4_language_id(spark, SF).collect()}
    truth = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "lang"]).to_pydict()
    right = [got[i].lang_pred == lang for i, lang in zip(truth["doc_id"], truth["lang"], strict=True) if got[i].held_out]
    assert len(got) == len(truth["doc_id"]) and len(right) > 150
    assert sum(right) / len(right) > 0.97


def test_odd_texts_and_rejection(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(base, F.lit(True))
    odd = [None, "", "   ", "12 34 !!", "日本語のテキスト" * 30, "the of and that with " * 9]
    df = spark.createDataFrame([(k, t, 0.5, "z") for k, t in enumerate(odd)], "doc_id long, text string, score double, extra string")
    rows = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].rejected and rows[k].score == 0 for k in range(4))
    assert rows[4].rejected and rows[4].lang_pred in model.langs
    assert not rows[5].rejected and rows[5].lang_pred == "en" and rows[5].extra == "z"
    assert langid.predict(df.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(df, None).collect()} == {"und"}
    assert langid.fit(base.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


@pytest.mark.parametrize("k", [1, 3, 9])
def test_kmeans_gives_unit_centroids(k):
    x = langid.vectors(["aaa", "aab", "zzz zz", "q"], 256)
    c, own = langid.spherical_kmeans(x, k)
    assert len(c) == min(k, 4) and len(own) == 4


def test_predictions_equal_brute_force(spark):
    """The nearest of all centroids by cosine, text by text, from plain dictionaries of n-grams."""
    rng, words = random.Random(1), {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["szczyt", "chrząszcz", "trzcina"], "cc": ["и", "не", "что", "быть"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 40))), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 30)]
    rows += [rows[0], rows[1], (None, "lorem ipsum", "aa"), (200, "lorem " * 20_000, "aa"), (201, None, "bb"), (202, "", "bb")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, row int, found int")
    model = langid.fit(df, F.lit(True), sample=25, dims=512)
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)

    def brute(text):
        folded = " " + " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()) + " "
        raw, counted = folded.encode(), collections.Counter()
        for n in range(1, 5):
            for i in range(len(raw) - n + 1):
                counted[raw[i : i + n]] += 1
        v = np.zeros(512)
        for g, c in counted.items():
            h = 0
            for j, byte in enumerate(g):
                h = (h * 0x9E3779B1 ^ (byte * 0x85EBCA77 + j)) % 2**32
            v[(h * 0xC2B2AE3D) % 2**32 >> 23] += c
        v = np.log1p(v) * model.idf
        cos = model.centroids @ (v / max(np.linalg.norm(v), 1e-9))
        return model.langs[model.owner[int(np.argmax(cos))]], float(cos.max())

    for r in got:
        if r.text and r.text.strip():
            lang, score = brute(r.text)
            assert r.lang_pred == lang and abs(r.score - min(score, 1)) < 1e-4
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
    assert langid.fit(df, F.lit(True), sample_bytes=1) is not None


def test_labelled_rows_without_ids_and_copies(spark):
    rng = random.Random(3)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit"], "bb": ["szczyt", "trzcina", "źdźbło"]}
    rows = [(None, " ".join(rng.choice(words[lang]) for _ in range(9)), lang) for lang in words for _ in range(2000)]
    rows += [(5, "one boilerplate line", "cc")] * 2000 + [(None, "uno", "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert model.langs == ["aa", "bb", "cc", "dd"]
    got = langid.predict(df.distinct(), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.99 * len(got)
