"""Motion-JPEG in AVI as a column: lossless storage of bytes, RIFF index parsing, intra decoding and shot detection.

A payload of 64-byte units is stored one unit per 8x8 block: every byte b is the quantised coefficient b + 256 (all
quantisers 1), so each one falls into magnitude category 9 and takes one Huffman bit and nine value bits. A block is
then exactly 80 bytes of scan data; a restart marker after every block resets the DC prediction and keeps blocks apart.
Frames are ordinary baseline JPEG interchange streams inside a RIFF AVI with an `idx1` index.

`decode_frame` is a general baseline decoder (grey or colour with sampling factors, any Huffman tables, restart
intervals, stuffing); frames with the constant-length tables above take a vectorised path. `samples` dequantises and
transforms back to luma samples, whose histograms tell shots apart. Stored payloads make extreme samples, as any
coefficients of that size do; the payload itself comes from the coefficients, which the format keeps exactly.

Defined results: media that is null, no AVI, or has a frame that is not baseline or comes without its tables gives null
values in `describe` and no row in `clips`; without the note of its units it is not a stored payload (null digests); null and empty texts are stored as 64 zero bytes; equal texts give equal media and features; repeated
rows and rows without an id each give their row; extra columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.text import as_bytes

UNIT = 64
FPS = 25
#: Fixed value: the zigzag order of an 8x8 block, by anti-diagonals of alternating direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_WAVES = 0.5 * np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.5), 1)[:, None]
_SCALE = 8192
#: The inverse transform of a block in zigzag order, in whole numbers: sums in doubles stay exact in any order.
_INVERSE = np.rint(np.kron(_WAVES, _WAVES)[ZIGZAG] * _SCALE)
_SHIFTS = np.array([30, 20, 10, 0], dtype=np.uint64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    table = bytes([1, *[0] * 15])  # one code of one bit
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\x00" + b"\x01" * 64),
            _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\x00" + table + b"\x09"),
            _segment(0xC4, b"\x10" + table + b"\x09"),
            _segment(0xDD, struct.pack(">H", 1)),
            _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
        ]
    )


def _scan_bytes(units: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of units (n x 64), 80 a unit, not yet stuffed."""
    value = units.reshape(-1, 16, 4).astype(np.uint64) + np.uint64(256)  # ten bits each: the code 0 and nine value bits
    packed = (value << _SHIFTS).sum(axis=2, dtype=np.uint64).astype(">u8")
    return np.ascontiguousarray(packed.view(np.uint8).reshape(len(units), 16, 8)[:, :, 3:]).reshape(len(units), 80)


def _stuffed(scan: np.ndarray) -> bytes:
    """Scan data of blocks with FF00 stuffing and a restart marker between blocks."""
    n = len(scan)
    out = [scan[k].tobytes().replace(b"\xff", b"\xff\x00") for k in range(n)]
    marks = [bytes([0xFF, 0xD0 + k % 8]) for k in range(8)]
    return b"".join(x + marks[k % 8] if k < n - 1 else x for k, x in enumerate(out))


def shape(units: int) -> tuple[int, int]:
    """Blocks across and down of each frame of a payload: at most 8 x 8."""
    across = min(8, units)
    return across, min(8, -(-units // across))


def to_avi(payload: bytes) -> bytes:
    """Payload (a positive multiple of 64 bytes) as a motion-JPEG AVI."""
    units = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    across, down = shape(len(units))
    each = across * down
    frames = -(-len(units) // each)
    padded = np.zeros((frames * each, UNIT), dtype=np.uint8)
    padded[: len(units)] = units
    head, width, height = _head(8 * across, 8 * down), 8 * across, 8 * down
    chunks, index, at = [], [], 4
    for f in range(0, frames, 64):  # bounded memory: 64 frames of bits at a time
        scan = _scan_bytes(padded[f * each : (f + 64) * each])
        for k in range(0, len(scan), each):
            jpeg = head + _stuffed(scan[k : k + each]) + b"\xff\xd9"
            chunks.append(struct.pack("<4sI", b"00dc", len(jpeg)) + jpeg + b"\x00" * (len(jpeg) % 2))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
            at += len(chunks[-1])
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\x00" * (len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    info = chunk(b"LIST", b"INFO" + chunk(b"ICMT", f"units={len(units)}".encode()))
    body = b"AVI " + hdrl + info + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def riff(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks between two places; a cut-off chunk ends with the data."""
    while start + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, start)
        yield name, start + 8, min(start + 8 + size, end)
        start += 8 + size + size % 2


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float, int | None]:
    """Places of the frames by the index (or by the movi chunks where there is none), frames a second, stored units."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    movi, index, fps, units = None, None, float(FPS), None
    for name, s, e in riff(data, 12, len(data)):
        kind = data[s : s + 4] if name == b"LIST" else b""
        if kind == b"movi":
            movi = (s, e)
        elif kind == b"hdrl":
            for n2, s2, _ in riff(data, s + 4, e):
                if n2 == b"avih" and (us := struct.unpack_from("<I", data, s2)[0]):
                    fps = 1_000_000 / us
        elif kind == b"INFO":
            for n2, s2, e2 in riff(data, s + 4, e):
                if n2 == b"ICMT" and data[s2 : s2 + 6] == b"units=":
                    units = int(data[s2 + 6 : e2])
        elif name == b"idx1":
            index = (s, e)
    if movi is None:
        return [], fps, units
    if index is None:
        return [(s, e) for n, s, e in riff(data, movi[0] + 4, movi[1]) if n[2:] in (b"dc", b"db")], fps, units
    rows = np.frombuffer(data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16], dtype=[("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    rows = rows[(rows["id"] == b"00dc") | (rows["id"] == b"00db")]
    base = movi[0] if not len(rows) or data[movi[0] + rows["at"][0] : movi[0] + rows["at"][0] + 4] == rows["id"][0] else 0
    return [(base + int(a) + 8, base + int(a) + 8 + int(n)) for a, n in zip(rows["at"], rows["size"], strict=True)], fps, units


class Frame(NamedTuple):
    """Luma of a frame: quantised coefficients (blocks x 64, zigzag order, in the order of the scan) and what places them."""

    values: np.ndarray
    quantisers: np.ndarray
    across: int
    sampling: tuple[int, int]
    height: int
    width: int


def _codes(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    """Huffman tables of a segment: (class and number, {(bits, code): symbol})."""
    while body:
        code, k, codes = 0, 17, {}
        for bits, many in enumerate(body[1:17], 1):
            for _ in range(many):
                codes[(bits, code)] = body[k]
                code, k = code + 1, k + 1
            code <<= 1
        yield body[0], codes
        body = body[k:]


def decode_frame(jpeg: bytes) -> Frame:
    """Luma coefficients of a baseline JPEG frame; ValueError for other kinds and for broken ones."""
    tables: dict[int, dict[tuple[int, int], int]] = {}
    quantisers: dict[int, np.ndarray] = {}
    parts: list[tuple[int, int, int, int]] = []
    at, every, height, width, scan = 2, 0, 0, 0, b""
    while at + 4 <= len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else np.uint8, count=64, offset=1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xDA:
            scan = body
            break
    if not parts or not scan or not height or not width or not all(1 <= n <= 4 for p in parts for n in p[1:3]):
        raise ValueError("no picture")
    chosen = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
    wanted = parts if len(chosen) > 1 else [(parts[0][0], 1, 1, parts[0][3])]  # a scan of its own has single blocks
    if any(p[0] not in chosen for p in wanted) or parts[0][3] not in quantisers:
        raise ValueError("luma stands in no scan, or has no quantisers")
    most_h, most_v = max(p[1] for p in wanted), max(p[2] for p in wanted)
    if wanted[0][1:3] != (most_h, most_v):
        raise ValueError("luma is sampled down")
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    try:
        codes = [(p[1] * p[2], tables[chosen[p[0]] >> 4], tables[0x10 | chosen[p[0]] & 15]) for p in wanted]
    except KeyError:
        raise ValueError("the frame lacks its tables") from None
    data, constant = np.frombuffer(jpeg, dtype=np.uint8, offset=at), {(1, 0): 9}
    if every == 1 and codes == [(1, constant, constant)]:
        values = _decode_constant(data, across * down)
    else:
        values = _decode_any(data, across * down, every, codes)
    return Frame(values, quantisers[parts[0][3]], across, (most_h, most_v), height, width)


def samples(frame: Frame) -> np.ndarray:
    """Luma samples (height x width) of a frame: dequantised, transformed back, shifted and clipped."""
    whole = (frame.values * frame.quantisers).astype(np.float64) @ _INVERSE
    pixels = np.clip(np.floor((whole + _SCALE / 2) / _SCALE) + 128, 0, 255).astype(np.uint8)
    h, v = frame.sampling
    image = pixels.reshape(-1, frame.across, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5)
    return image.reshape(-1, frame.across * h * 8)[: frame.height, : frame.width]


def _unstuffed(scan: np.ndarray) -> np.ndarray:
    """Scan data without stuffing, restart markers and what follows the end of image."""
    after = np.zeros(len(scan), dtype=bool)
    after[1:] = scan[:-1] == 0xFF
    mark = after & (scan != 0)
    drop = (after & (scan == 0)) | mark
    drop[:-1] |= mark[1:]
    return scan[~drop]


def _decode_constant(scan: np.ndarray, blocks: int) -> np.ndarray:
    data = _unstuffed(scan)[: 80 * blocks]
    if len(data) < 80 * blocks:
        raise ValueError("the scan ends early")
    data = data.reshape(blocks, 80)
    wide = np.zeros((blocks, 16, 8), dtype=np.uint8)
    wide[:, :, 3:] = data.reshape(blocks, 16, 5)
    packed = wide.view(">u8").astype(np.uint64)
    return ((packed >> _SHIFTS) & np.uint64(1023)).reshape(blocks, UNIT).astype(np.int32)


def _decode_any(scan: np.ndarray, units: int, every: int, codes: list[tuple[int, dict, dict]]) -> np.ndarray:
    """Coefficients of the first component out of `units` coded units, each with the given number of blocks of every component."""
    first = codes[0][0]
    out = np.zeros((units * first, 64), dtype=np.int32)
    after = np.r_[False, scan[:-1] == 0xFF]
    cuts = np.flatnonzero(after & (scan >= 0xD0) & (scan <= 0xD9))
    edges = [0, *(int(c) + 1 for c in cuts)]
    parts = [scan[a : int(c) - 1] for a, c in zip(edges, cuts, strict=False)] + [scan[edges[-1] :]]
    done = 0
    for part in parts:
        data = part[~np.r_[False, (part[:-1] == 0xFF) & (part[1:] == 0)]] if len(part) else part
        bits = "".join(f"{b:08b}" for b in data.tobytes())
        at, last, stop = 0, [0] * len(codes), min(units, done + (every or units))

        def taken(n: int) -> str:
            nonlocal at
            if at + n > len(bits):  # noqa: B023
                raise ValueError("the scan ends early")
            at += n
            return bits[at - n : at]  # noqa: B023

        def symbol(table: dict) -> int:
            nonlocal at
            for n in range(1, 17):
                if at + n <= len(bits) and (found := table.get((n, int(bits[at : at + n], 2)))) is not None:  # noqa: B023
                    at += n
                    return found
            raise ValueError("bad code")

        def value(n: int) -> int:
            if not n:
                return 0
            v = int(taken(n), 2)
            return v if v >> (n - 1) else v - (1 << n) + 1

        while done < stop:
            for c, (blocks, dc, ac) in enumerate(codes):
                for i in range(blocks):
                    block = np.zeros(64, dtype=np.int32) if c else out[done * first + i]
                    last[c] += value(symbol(dc))
                    block[0] = last[c]
                    k = 1
                    while k < 64 and (rs := symbol(ac)):
                        k += rs >> 4
                        if rs & 15:
                            v = value(rs & 15)
                            if k > 63:
                                raise ValueError("bad run")
                            block[k] = v
                        k += 1
            done += 1
    if done < units:
        raise ValueError("the scan ends early")
    return out


class Media(NamedTuple):
    payload: bytes | None
    histograms: list[np.ndarray]
    fps: float


def read_back(data: bytes) -> Media:
    """Payload (of an AVI written by to_avi), the frames' luma histograms and frames a second."""
    places, fps, units = parse_avi(data)
    parts, histograms = [], []
    for s, e in places:
        frame = decode_frame(data[s:e])
        if units is not None:
            parts.append((frame.values - 256).astype(np.uint8).tobytes())
        histograms.append(np.bincount(samples(frame).ravel() >> 2, minlength=64))
    return Media(b"".join(parts)[: UNIT * units] if units is not None else None, histograms, fps)


def readable(data: bytes | None) -> Media | None:
    """read_back, or None for what is no motion-JPEG AVI that it can read."""
    try:
        return read_back(bytes(data)) if data is not None else None
    except (ValueError, IndexError, struct.error):
        return None


def shots(histograms: list[np.ndarray], window: int = 12, times: float = 3.0, least: float = 0.25) -> list[tuple[int, int]]:
    """[first, last) frames of each shot. A cut stands where the histogram difference exceeds `least` and the mean of
    the differences around it (window on either side, itself left out) plus `times` their standard deviation."""
    n = len(histograms)
    if n < 2:
        return [(0, n)] if n else []
    h = np.array(histograms, dtype=np.float64)
    h /= np.maximum(h.sum(axis=1, keepdims=True), 1)
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    sums, squares = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    at = np.arange(n - 1)
    lo, hi = np.maximum(at - window, 0), np.minimum(at + window + 1, n - 1)
    count = np.maximum(hi - lo - 1, 1)
    mean = (sums[hi] - sums[lo] - d) / count
    spread = np.sqrt(np.maximum((squares[hi] - squares[lo] - d * d) / count - mean * mean, 0))
    cuts = np.flatnonzero((d > least) & (d > mean + times * spread)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and the column `media`: each text's payload as an AVI."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                raw = [as_bytes(t) for t in part["text"]]
                media = [to_avi(b + b"\x00" * (UNIT - len(b) % UNIT if len(b) % UNIT or not b else 0)) for b in raw]
                yield pd.DataFrame({"id": part["id"], "n_bytes": [len(b) for b in raw], "media": media})

    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, n_bytes long, media binary").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def describe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads the media column: payload digests, media digests and a summary of frames and shots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, n, data in zip(pdf["id"], pdf["n_bytes"], pdf["media"], strict=True):
                if (found := readable(data)) is None:
                    rows.append((i, n, None, None, None, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, None))
                    continue
                payload, histograms, fps = found
                cuts = shots(histograms)
                feature = f"frames={len(histograms)};fps={fps:g};shots={len(cuts)};starts_ms=" + ",".join(str(round(1000 * s / fps)) for s, _ in cuts)
                digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:])) if payload is not None else (None,) * 3
                rows.append((i, n, *digests, len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"], dtype=object)

    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), "n_bytes", F.col(media_col).alias("media"))
    return rows.mapInPandas(run, "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per shot of each media: id, clip, first_frame, frames, start_s, end_s. Media that cannot be read gives none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, data in zip(pdf["id"], pdf["media"], strict=True):
                if (found := readable(data)) is None:
                    continue
                _, histograms, fps = found
                rows += [(i, k, s, e - s, s / fps, e / fps) for k, (s, e) in enumerate(shots(histograms))]
            yield pd.DataFrame(rows, columns=["id", "clip", "first_frame", "frames", "start_s", "end_s"])

    kind = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInPandas(run, "id string, clip int, first_frame long, frames long, start_s double, end_s double").withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
