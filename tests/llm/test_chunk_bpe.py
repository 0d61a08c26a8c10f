import collections
import hashlib
import random
import time

import numpy as np
import pyarrow.parquet as pq
from siltstone.llm import chunk_bpe as cb
from siltstone.llm.queries import tokenizer_path
from tokenizers import Tokenizer

PATH = tokenizer_path("word_bpe_49k.json")


def test_equals_the_library(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rng = random.Random(4)
    shared = " ".join(rng.choice(texts[0].split()) for _ in range(400))
    texts += [None, "", " ", "x" * 20_000, "é" * 5000, "a<|endoftext|>b <|startoftext|>", "ΑΣ ς Σ", "é ́", "\x0b\x0c \x85\xa0　z", "it's I'LL 1234", "\U0001f600 \U0001f468‍\U0001f469"]
    texts += [f"{rng.random()} {shared} {rng.random()}" for _ in range(20)] + texts[:5] + texts[-3:]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7)], "doc_id long, text string, ids int")
    tok = Tokenizer.from_file(PATH)
    got = cb.digest(df, PATH).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids), repr(texts[r.doc_id][:80])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert cb.digest(df.limit(0), PATH).count() == 0


def test_any_cuts_are_repaired():
    words, rng = cb.Words(PATH), random.Random(2)
    text = "  hello, wörld's   unbelievable\n\nantidisestablishmentarianism x<|endoftext|>y  ".encode() * 3
    want = words.library(text)
    for _ in range(200):
        places = [p for p in range(1, len(text)) if text[p] & 0xC0 != 0x80]
        ends = sorted(rng.sample(places, rng.randrange(1, 40))) + [len(text)]
        chunks = [cb.encode_chunk(text[s:e], words) for s, e in zip([0, *ends], ends, strict=False)]
        chunks = [cb.Chunk.unpacked(c.packed()) for c in chunks]
        assert cb.join_chunks(text, ends, chunks, words) == want


def test_cuts_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 20_000).astype(np.uint8))
    a, b = b"start " + passage, b"another beginning of it " + passage
    ends = cb.cut_points([a, b, b"", b"short"])
    chunks = [{raw[s:e] for s, e in zip(np.r_[0, x], x, strict=False)} for raw, x in zip((a, b), ends, strict=False)]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])
    assert ends[2].tolist() == [] and ends[3].tolist() == [5]


def test_repeated_rows_are_encoded_once(spark):
    """2,000 equal rows take about as long as 200: no row meets the others' chunks."""
    rng, tok = random.Random(6), Tokenizer.from_file(PATH)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1200))
    seconds = []
    for n in (20, 200, 2000):
        df = spark.createDataFrame([(None, text)] * n + [(1, text), (2, None), (2, None)], "doc_id string, text string").repartition(8)
        start = time.time()
        got = cb.digest(df, PATH).collect()
        seconds.append(time.time() - start)
        assert len(got) == n + 3 and collections.Counter(r.doc_id for r in got) == {None: n, "1": 1, "2": 2}
        assert {(r.doc_id == "2", r.n_tokens) for r in got} == {(True, 0), (False, len(tok.encode(text, add_special_tokens=False).ids))}
    assert seconds[2] < 5 * seconds[1] + 5
    swapped = spark.createDataFrame([(None, "a b"), ("a b", None)], "doc_id string, text string")
    assert {(r.doc_id, r.n_tokens) for r in cb.digest(swapped, PATH).collect()} == {(None, 2), ("a b", 0)}
