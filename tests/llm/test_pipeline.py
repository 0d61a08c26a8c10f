import struct
import zlib

import corpus_pipeline
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from siltstone.llm.queries import tokenizer_path
from test_near_duplicates import brute as groups_of
from test_suffix_dedup import brute as repeats_of
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    rows = sorted(kept.collect())
    firsts = {g for _, _, g in groups_of([r.text for r in rows], 5, 80, 100)}
    once = corpus_pipeline.duplicates(spark, kept, SF)
    assert sorted(r.doc_id for r in once.collect()) == sorted(rows[g].doc_id for g in firsts)
    rows = sorted(once.collect())
    want = [r[1] - r[2] for r in repeats_of([r.text for r in rows], 200)]
    clean = corpus_pipeline.repeats(spark, once, SF)
    got = sorted(clean.collect())
    assert [r.doc_id for r in got] == [r.doc_id for r in rows] and clean.columns == docs.columns
    for r, n in zip(got, want, strict=True):
        assert n - 6 * 2 <= len(r.text.encode()) <= n and r.n_chars == len(r.text)
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    packed = corpus_pipeline.pack(spark, clean, SF).collect()
    by_doc = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [0] for r in got}
    assert {r.doc_id for r in packed} == set(by_doc)
    for r in packed:
        part = by_doc[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32


def test_odd_rows(spark):
    t = pq.read_table(f"{SF}/documents.parquet").slice(0, 60).to_pylist()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 0.5) for r in t]
    rows += [(900, None, None, None, None, None), (901, "", "en", None, 0, None), (None, t[0]["text"], "en", None, 1, None), (902, "12 34", "en", "s", 5, None), rows[1]]
    other = "A sentence of its own that shares its number with another one and shall not be lost for that reason."
    rows.append((rows[2][0], other, "en", "s", 1, None))
    names = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for c in ("_2", "_uid", "uid", "row", "rejected", "spans", "_of", "a.b"):
        docs, names = docs.withColumn(c, F.lit(c)), [*names, c]
    docs = docs.cache()
    bare = docs.select("doc_id", "text", "lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, bare = stage(spark, docs, SF), stage(spark, bare, SF)
        assert docs.columns == names and bare.columns == ["doc_id", "text", "lang"]
    got = [(r.doc_id, r.text) for r in docs.collect()]
    ids = [i for i, _ in got]
    assert len(got) == len(set(got)) and None in ids and not {900, 901, 902} & set(ids) and any(x and x.startswith(other[:20]) for _, x in got)
    assert corpus_pipeline.duplicates(spark, docs.limit(0), SF).count() == 0


def test_text_ids_and_many_equal_rows(spark):
    """Ids that are texts; 2,000 equal rows without an id go through stages 1 to 3."""
    texts = [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").slice(0, 30).to_pylist()]
    rows = [(f"k{i}", t, "en") for i, t in enumerate(texts)] + [("a0", texts[0], "en")] + [(None, texts[1], "en")] * 2000
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(8)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in docs.collect()]
        assert ids.count(None) == 2000
        assert ("k0" in ids) == (name == "language") and "a0" in ids
