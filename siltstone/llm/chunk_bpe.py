"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts every text into chunks by content alone, so passages that documents share
fall into the same chunks. Chunks that occur more than once (counted by hash over all documents) are encoded once, by
the document that holds the first of them, and joined back; the others are encoded where they are. White space ends a
pre-token for this tokenizer, so inside a chunk everything between its first and its last white space encodes as it
does in the text. The joins are repaired: what stands between the last white space of one chunk and the first of the
next is re-encoded together with one more word on each side, and the window grows by a word on a side until its tokens
there agree exactly with those of the chunk. Decoding joins the tokens' strings the way the library does.

Words keep their ids in a bounded cache within a task. The texts are dealt once, compressed, by a hash of id and text.
Defined results: null and empty texts have no ids; repeated rows each give their row; extra columns are ignored
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import as_bytes, blocks, prefix, slice_hashes

WINDOW = 32
#: White space at which bytes.split() cuts; the tokenizer ends a pre-token at each of them.
_SPACE = b" \t\n\r\x0b\x0c"


def cut_points(raw: list[bytes], bits: int = 10, least: int = 128, most: int = 4096) -> list[np.ndarray]:
    """Ends of the chunks of each text: where `bits` bits of the rolling hash are zero, at least `least` bytes after the
    cut before and never inside a character; stretches without such a place are cut every `most` bytes."""
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    if len(data) < WINDOW:
        return [np.array([len(b)] if b else [], dtype=np.int64) for b in raw]
    sums = prefix(data)
    at = np.arange(len(data) - WINDOW + 1)
    hits = np.flatnonzero((slice_hashes(sums, at, at + WINDOW) >> np.uint64(64 - bits)) == 0) + WINDOW
    out, first = [], 0
    for b in raw:
        end, own = first + len(b), []
        lo, hi = np.searchsorted(hits, [first + WINDOW, end])
        last = first
        for c in [*hits[lo:hi].tolist(), end]:
            while c - last > most:
                last += most
                while last > first and last < end and data[last] & 0xC0 == 0x80:
                    last -= 1
                own.append(last - first)
            if (c - last >= least and (c == end or data[c] & 0xC0 != 0x80)) or c == end:
                if c > last:
                    own.append(c - first)
                last = c
        out.append(np.array(own, dtype=np.int64))
        first = end
    return out


class Words(dict):
    """word -> its ids, little-endian unsigned 32-bit; a bounded cache in front of the library. When it is full it becomes
    the older half, from which words in use come back, and what is not asked for again goes with it."""

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.most, self.older = Tokenizer.from_file(path), most, {}
        self.tok.no_truncation()
        self.tok.no_padding()

    def library(self, text: bytes) -> bytes:
        return array("I", self.tok.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids).tobytes()  # native order: little-endian on all machines Spark runs on

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        if (kept := self.older.get(word)) is not None:
            ids = kept
        elif word.isascii() and b"<" not in word and not word.islower() and word.lower() != word:
            ids = self[word.lower()]  # the normaliser lowers; special strings, which it leaves alone, hold a "<"
        elif core != word and core[-1:].isalnum():
            ids = self[core] + self[word[len(core) :]]  # signs after a letter or digit are a pre-token of their own
        else:
            ids = self.library(word)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """Kept by a worker from one task to the next."""
    return Words(path)


def unpacked(column: pd.Series) -> list[bytes]:
    z = zstandard.ZstdDecompressor()
    return [z.decompress(b) for b in column]


class Chunk(NamedTuple):
    """A chunk encoded alone: bytes before its first and after its last white space, how many bytes of ids they have,
    whether it has no white space at all, and its ids."""

    head: int
    tail: int
    head_ids: int
    tail_ids: int
    solid: bool
    ids: bytes

    def packed(self) -> bytes:
        return struct.pack("<4I?", *self[:5]) + self.ids

    @staticmethod
    def unpacked(b: bytes) -> Chunk:
        return Chunk(*struct.unpack_from("<4I?", b), b[17:])


def encode_chunk(chunk: bytes, words: Words) -> Chunk:
    """White space always ends a pre-token, so the words of a chunk are encoded one by one."""
    own = chunk.split()
    each = list(map(words.__getitem__, own))
    first, last = chunk[0] in _SPACE, chunk[-1] in _SPACE
    if len(own) == 1 and not first and not last:
        return Chunk(0, 0, 0, 0, True, each[0])
    head, tail = (0 if first else len(own[0])), (0 if last else len(own[-1]))
    return Chunk(head, tail, len(each[0]) if head else 0, len(each[-1]) if tail else 0, False, b"".join(each))


def _beside(raw: bytes, at: int, way: int) -> int:
    """The far end of the word before (way -1) or after (way 1) a place between words."""
    for inside in (False, True):
        while 0 <= (i := at + min(way, 0)) < len(raw) and (raw[i] not in _SPACE) == inside:
            at += way
    return at


def repair(raw: bytes, start: int, stop: int, words: Words) -> bytes:
    """Ids of the word raw[start:stop] that a chunk end has cut. The window around it holds whole words on either side;
    it is encoded anew by the library, and grows until the outer words have exactly the ids they have in their chunks."""
    a, b = start, stop
    while True:
        a, b = _beside(raw, a, -1), _beside(raw, b, 1)
        window = words.library(raw[a:b])
        left, right = (b"".join(map(words.__getitem__, part.split())) for part in (raw[a:start], raw[stop:b]))
        if window.startswith(left) and window.endswith(right):
            return window[len(left) : len(window) - len(right)]
        if a == 0 and b == len(raw):
            raise ValueError("no agreement even over the whole text")


def join_chunks(raw: bytes, ends: list[int], chunks: list[Chunk], words: Words) -> bytes:
    """Ids of the whole text from its chunks, the words cut by chunk ends repaired."""
    parts, pos, start, known = [], 0, None, None  # start: of a word that is still open; known: its ids unless it was cut
    for end, c in zip(ends, chunks, strict=True):
        if c.solid:
            start, known = (pos, c.ids) if start is None else (start, None)
        else:
            if start is not None:
                parts.append(known if known is not None and not c.head else repair(raw, start, pos + c.head, words))
            elif c.head:
                parts.append(c.ids[: c.head_ids])
            parts.append(c.ids[c.head_ids : len(c.ids) - c.tail_ids])
            start, known = (end - c.tail, c.ids[len(c.ids) - c.tail_ids :]) if c.tail else (None, None)
        pos = end
    if start is not None:
        parts.append(known if known is not None else repair(raw, start, pos, words))
    return b"".join(parts)


def slices(raw: bytes, ends: np.ndarray) -> list[bytes]:
    edge = [0, *ends.tolist()]
    return [raw[s:e] for s, e in zip(edge, edge[1:], strict=False)]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish=None, columns: str = "ids binary") -> DataFrame:
    """id and `ids` (little-endian unsigned 32-bit token ids, packed) of every row. With `finish`, a function of a list
    of packed ids, the frame that it returns (of the given columns) takes their place within the same pass."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("uid", F.xxhash64("id", "text", F.col("id").isNull(), F.col("text").isNull()))

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=6)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "z": [z.compress(as_bytes(t)) for t in pdf["text"]], "uid": pdf["uid"]})

    # one exchange of the compressed texts serves all three passes: each takes all its columns and hands on none of them
    # under their own names, so Spark sees the same exchange and runs it once. Equal rows are one row with their number,
    # within each task already, so a row repeated without bound neither meets in one task nor multiplies its chunks
    once = F.first("id").alias("id"), F.first("z").alias("z"), F.count("*").alias("times")
    dealt = rows.mapInPandas(squeeze, f"id {kind}, z binary, uid long not null").groupBy("uid").agg(*once)

    def chop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, ids = unpacked(pdf["z"]), pdf["uid"].to_numpy()
            for s, e in blocks(raw):
                ends = cut_points(raw[s:e])
                sums = prefix(np.frombuffer(b"".join(raw[s:e]), dtype=np.uint8))
                first = np.cumsum([0, *(len(b) for b in raw[s:e])])[:-1]
                n = [len(x) for x in ends]
                starts = np.concatenate([first[k] + np.r_[0, x[:-1]] for k, x in enumerate(ends) if len(x)] or [np.zeros(0)]).astype(np.int64)
                stops = np.concatenate([first[k] + x for k, x in enumerate(ends) if len(x)] or [np.zeros(0)]).astype(np.int64)
                place = np.arange(len(starts)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"of": np.repeat(ids[s:e], n), "k": place, "hash": slice_hashes(sums, starts, stops).view(np.int64)})

    places = dealt.mapInPandas(chop, "of long, k int, hash long")
    shared = places.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("of", "k")).alias("first")).where("n > 1")
    wanted = shared.select(F.col("first.of").alias("of"), F.struct("hash", F.col("first.k").alias("k")).alias("w")).groupBy("of").agg(F.collect_list("w").alias("wanted"))

    def encode_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(path)
        for pdf in batches:
            out = []
            for raw, want in zip(unpacked(pdf["z"]), pdf["wanted"], strict=True):
                own = slices(raw, cut_points([raw])[0])
                out += [(w["hash"], encode_chunk(own[w["k"]], words).packed()) for w in want]
            yield pd.DataFrame(out, columns=["hash", "chunk"])

    encoded = dealt.join(wanted, F.col("uid") == F.col("of")).mapInPandas(encode_shared, "hash long, chunk binary").groupBy("hash").agg(F.first("chunk").alias("chunk"))
    uses = places.join(encoded, "hash").groupBy("of").agg(F.collect_list(F.struct("k", "chunk")).alias("known"))  # no more than a text's own chunks

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = words_of(path)
        for pdf in batches:
            raw, out = unpacked(pdf["z"]), []
            for s, e in blocks(raw):
                for b, ends, known in zip(raw[s:e], cut_points(raw[s:e]), pdf["known"].iloc[s:e], strict=True):
                    have = {} if known is None else {x["k"]: x["chunk"] for x in known}
                    own = [Chunk.unpacked(have[k]) if k in have else encode_chunk(c, words) for k, c in enumerate(slices(b, ends))]
                    out.append(join_chunks(b, ends.tolist(), own, words))
            made = pd.DataFrame({"ids": out}) if finish is None else finish(out)
            made.insert(0, "id", pdf["id"].to_numpy())
            made["times"] = pdf["times"].to_numpy()
            yield made

    out = dealt.join(uses, F.col("uid") == F.col("of"), "left").mapInPandas(assemble, f"id {kind}, {columns}, times long")
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")
    return each.withColumnRenamed("id", id_col)


class Decoder:
    """Token strings as the library's decode joins them: one space between tokens (the file names no decoder)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        if tok.decoder is not None:
            raise ValueError("only vocabularies without a decoder of their own are joined by spaces")
        names = tok.get_vocab(with_added_tokens=True)
        self.strings = [""] * (max(names.values()) + 1)
        self.numbers = [str(i) for i in range(len(self.strings))]
        for token, i in names.items():
            self.strings[i] = token

    def __call__(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=1)
def decoder_of(path: str) -> Decoder:
    return Decoder(path)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and `decoded`, the text of the packed ids; null ids have a null text."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = decoder_of(path)
        for ids in batches:
            yield pd.Series([None if b is None else decoder(np.frombuffer(b, dtype="<u4").tolist()) for b in ids], dtype=object)

    return df.select(id_col, ids_col, run(ids_col).alias("decoded"))


def digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes every text, then decodes its ids."""

    def digests(packed: list[bytes]) -> pd.DataFrame:
        decoder, rows = decoder_of(path), []
        for b in packed:
            ids = np.frombuffer(b, dtype="<u4").tolist()
            rows.append((len(ids), hashlib.sha256(" ".join(map(decoder.numbers.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoder(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(df, path, id_col, text_col, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")
