import struct
import zlib

import pyarrow.parquet as pq
import pytest
from siltstone.llm import packing, token_counts
from siltstone.llm.queries import tokenizer_path
from tokenizers import Tokenizer

ODD = [None, "", " ", "  a", "a  ", "a \n b", "x<|endoftext|> y <|endoftext|>", "\n", "it's  I'll\t\tb", " 　 x", "a\x1cb \x1c c", "😀 😀😀 a", "𒑵 𖿴x", "x" * 5000, "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() + ODD + ODD[3:6]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_counts_equal_the_library(docs):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(tok.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_packing_is_whole_and_tight(docs):
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=256).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and len(own) == -(-len(ids) // 256)
        at = 0
        for r in own:
            part = ids[at : at + r.length]
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            at += r.length
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by_bin) <= -(-total // 256) + 1


def test_plan_reaches_the_best_number_of_bins():
    assert sum(t for _, t in packing.plan_bins({6: 2, 4: 2, 5: 2, 3: 1, 2: 1}, 10)) == 4
    assert sum(t for _, t in packing.plan_bins({7: 1, 5: 2, 4: 1, 3: 2, 2: 1}, 10)) == 3
    assert packing.plan_bins({}, 10) == []


def test_search_goes_on_behind_forced_steps():
    assert sum(t for _, t in packing.plan_bins({4: 2, 6: 2, 18: 1, 10: 1, 11: 1, 20: 1, 12: 1, 5: 1}, 20)) == 5
    assert sum(t for _, t in packing.plan_bins({8: 2, 19: 1, 3: 1, 4: 2, 11: 1, 2: 2, 18: 1}, 20)) == 4
    plan = packing.plan_bins({25: 1, 27: 1, 20: 1, 93: 1, 15: 1, 14: 1, 79: 1, 50: 1, 21: 1, 44: 1, 100: 5}, 100, nodes=50)
    assert sum(t for _, t in plan) == 9


def test_fillings_are_whole_and_undominated():
    assert packing.fillings(10, [9, 5, 2], {9: 1, 5: 2, 2: 1}, 8) == [(0, ((5, 2),)), (1, ((9, 1),))]
    assert packing.fillings(10, [6, 5, 4], {6: 1, 5: 1, 4: 1}, 8) == [(0, ((6, 1), (4, 1)))]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0
