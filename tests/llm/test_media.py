import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from siltstone.llm import media
from siltstone.llm.queries import op9_media_columns


@pytest.mark.parametrize("n", [64, 128, 64 * 63, 64 * 64, 64 * 65, 64 * 1000])
def test_round_trip(n):
    for payload in (os.urandom(n), b"\xff" * n, b"\x00" * n):
        data = media.to_avi(payload)
        assert media.read_back(data)[0] == payload


def test_general_decoder_agrees_with_the_constant_one():
    payload = bytes(range(256)) * 2
    data = media.to_avi(payload)
    (s, e), *_ = media.parse_avi(data)[0]
    scan = np.frombuffer(data[s:e], dtype=np.uint8, offset=len(media._head(8, 8)))
    table = {(1, 0): 9}
    assert (media._decode_any(scan, 8, 1, [(1, table, table)]) == media._decode_constant(scan, 8)).all()


def test_zigzag_starts_as_defined():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_shots_find_planted_cuts():
    rng = np.random.default_rng(1)
    a, b = np.zeros(64), np.zeros(64)
    a[:20], b[30:] = 1, 1
    frames = [rng.multinomial(4000, p / p.sum()) for p in [a] * 15 + [b] * 10 + [a] * 20]
    assert media.shots(frames) == [(0, 15), (15, 25), (25, 45)]
    assert media.shots([]) == [] and media.shots(frames[:1]) == [(0, 1)]


def test_column(spark):
    texts = [None, "", "é" * 40, "x" * 64, "x" * 64, "long text " * 5000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    stored = media.store(df)
    for r in media.describe(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    rows = media.clips(stored).collect()
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    large = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert sorted(str(r.doc_id) for r in media.describe(media.store(large)).collect()) == [str((1 << 60) + 1), "None", "None"]
    assert media.describe(media.store(df.limit(0))).count() == 0


WAVES = np.array([[np.cos((2 * n + 1) * k * np.pi / 16) * (np.sqrt(1 / 8) if k == 0 else 0.5) for n in range(8)] for k in range(8)])
Q = np.arange(3, 67)


def colour_jpeg(luma: np.ndarray, every: int) -> bytes:
    """A 4:2:0 frame with its own tables (4 bits a DC category, 9 bits an AC symbol), coded from the definitions."""
    h, w = luma.shape
    rows, cols = -(-h // 16), -(-w // 16)
    full = np.pad(luma, ((0, rows * 16 - h), (0, cols * 16 - w)), mode="edge").astype(float) - 128
    bits, last, out = "", [0, 0, 0], b""

    def number(v: int) -> tuple[int, str]:
        n = int(abs(v)).bit_length()
        return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""

    def block(px: np.ndarray, c: int) -> str:
        f = np.rint((WAVES @ px @ WAVES.T).ravel()[media.ZIGZAG] / Q).astype(int)
        n, text = number(f[0] - last[c])
        code, last[c], run = f"{n:04b}{text}", f[0], 0
        for v in f[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                code, run = code + f"{0xF0:09b}", run - 16
            n, text = number(v)
            code, run = code + f"{run << 4 | n:09b}{text}", 0
        return code + (f"{0:09b}" if run else "")

    def closed(bits: str) -> bytes:
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(rows * cols):
        if m and m % every == 0:
            out, bits, last = out + closed(bits) + bytes([0xFF, 0xD0 + (m // every - 1) % 8]), "", [0, 0, 0]
        y, x = m // cols * 16, m % cols * 16
        for dy, dx in ((0, 0), (0, 8), (8, 0), (8, 8)):
            bits += block(full[y + dy : y + dy + 8, x + dx : x + dx + 8], 0)
        for c in (1, 2):
            bits += block(np.full((8, 8), 10.0 * c + m), c)
    dc = bytes([0, 0, 0, 12, *[0] * 12]) + bytes(range(12))
    ac = bytes([*[0] * 8, 250, *[0] * 7]) + bytes(range(250))
    seg = media._segment
    head = b"\xff\xd8" + seg(0xDB, b"\x00" + bytes(Q.tolist())) + seg(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    return head + seg(0xC4, b"\x00" + dc + b"\x10" + ac) + seg(0xDD, struct.pack(">H", every)) + seg(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + out + closed(bits) + b"\xff\xd9"


def expected(luma: np.ndarray) -> np.ndarray:
    h, w = luma.shape
    full = np.pad(luma, ((0, -h % 16), (0, -w % 16)), mode="edge").astype(float) - 128
    for y in range(0, full.shape[0], 8):
        for x in range(0, full.shape[1], 8):
            f = np.zeros(64)
            f[media.ZIGZAG] = np.rint((WAVES @ full[y : y + 8, x : x + 8] @ WAVES.T).ravel()[media.ZIGZAG] / Q) * Q
            full[y : y + 8, x : x + 8] = WAVES.T @ f.reshape(8, 8) @ WAVES
    return np.clip(full + 128, 0, 255)[:h, :w]


@pytest.mark.parametrize(("h", "w", "every"), [(16, 16, 1), (21, 37, 2), (40, 24, 100)])
def test_colour_frames_decode_to_samples(h, w, every):
    rng = np.random.default_rng(h)
    luma = np.clip(rng.integers(0, 256, (h, w)) // 2 + np.linspace(0, 120, w)[None, :], 0, 255)
    got = media.samples(media.decode_frame(colour_jpeg(luma, every)))
    assert got.shape == (h, w) and np.abs(got - expected(luma)).max() <= 1


def avi_of(frames: list[bytes]) -> bytes:
    """Another writer's layout: no index, no note of units, an odd chunk of sound between frames."""
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)
    movi = b"".join(chunk(b"00dc", f) + chunk(b"01wb", b"abc") for f in frames)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + movi))


def test_clips_of_foreign_and_broken_media(spark):
    dark, light = colour_jpeg(np.full((20, 20), 30.0), 1), colour_jpeg(np.full((20, 20), 200.0), 1)
    whole = avi_of([dark] * 15 + [light] * 10)
    rows = [(1, 0, whole), (2, 0, None), (3, 0, b"no media"), (4, 0, avi_of([dark, dark[:200]])), (5, 0, avi_of([dark.replace(b"\xff\xc0", b"\xff\xc2", 1)])), (6, 0, whole[:30]), (None, 0, avi_of([]))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    found = sorted(tuple(r) for r in media.clips(df).collect())
    assert found == [(1, 0, 0, 15, 0.0, 1.5), (1, 1, 15, 10, 1.5, 2.5)]
    seen = {r.doc_id: r for r in media.describe(df).collect()}
    assert seen[1].feature == "frames=25;fps=10;shots=2;starts_ms=0,1500" and seen[1].payload_sha256 is None and seen[1].media_bytes == len(whole)
    assert [seen[i].feature for i in (2, 3, 4, 5)] == [None] * 4 and seen[2].media_sha256 is None


def walk(data, at, end):
    """(name, start, size) of the chunks of a RIFF file, lists entered."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name in (b"RIFF", b"LIST"):
            yield from walk(data, at + 12, at + 8 + size)
        else:
            yield name, at + 8, size
        at += 8 + size + size % 2


def test_query_over_all_documents(spark):
    """Payload digests by hand; the stored form walked chunk by chunk: its frames are those that the feature counts."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    files = {r.doc_id: bytes(r.media) for r in media.store(docs).collect()}
    got = {r.doc_id: r for r in op9_media_columns(spark, sf).collect()}
    assert got.keys() == texts.keys()
    by_text = {}
    for i, r in got.items():
        payload = texts[i] + b"\0" * (max(64, -(-len(texts[i]) // 64) * 64) - len(texts[i]))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[i]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = files[i]
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert data[:4] == b"RIFF" and data[8:12] == b"AVI " and struct.unpack_from("<I", data, 4)[0] + 8 == len(data)
        frames = [data[s : s + n] for name, s, n in walk(data, 0, len(data)) if name in (b"00dc", b"00db")]
        assert frames and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)
        starts = [int(x) for x in r.feature.partition("starts_ms=")[2].split(",")]
        assert r.feature.startswith(f"frames={len(frames)};") and f"shots={len(starts)};" in r.feature and starts[0] == 0 and starts == sorted(starts)
        assert by_text.setdefault(texts[i], tuple(r)[1:]) == tuple(r)[1:]
