"""WARC archives: writing with revisit records, normalising whole-file gzip streams, reading through an offset index.

`write` puts each partition's pages into one archive that is a single gzip stream (what naive crawlers leave behind).
`normalise` inflates such a stream once, front to back with bounded memory, rewrites every record as a gzip member of
its own and writes a sidecar index (JSON lines: offset, length, type, id, uri) beside it. `read` seeks to each indexed
member and parses it alone. Archives live in the shared folder and are opened by pyarrow's file systems, so executors
need no common local disk; attempts write files of their own name, and only the files of finished tasks are listed.

Of records with equal payloads of at least `least` bytes that with the largest id is the response, the others revisit
it; shorter ones are all responses. Revisit records keep the HTTP head (with the payload's length) and its digest.

Defined results: a null html is an empty payload; a null url leaves the target out; rows that repeat the largest id are
each a response; rows with a null id are responses nobody refers to; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.tables import partitions, shared_dir, stored
from siltstone.llm.text import as_bytes

#: Fixed values of the WARC format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 20
_KNOWN, _UNKNOWN = 2, 3


def record_id(page_id: int | None, digest: bytes = b"") -> str:
    """A URN that carries the page id in its low 64 bits; without an id it carries part of the digest."""
    low = int.from_bytes(digest[:8], "big") if page_id is None else page_id % (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=(_UNKNOWN if page_id is None else _KNOWN) << 126 | low)}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    low = value & ((1 << 64) - 1)
    return None if value >> 126 != _KNOWN else low - (1 << 64) if low >> 63 else low


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in as_bytes(c)) for c in url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def headers(record: bytes) -> tuple[dict[str, str], int]:
    """Header fields (names lower-cased) and where the block starts."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


def parse(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    fields, start = headers(record)
    block = record[start : start + int(fields["content-length"])]
    top, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("latin-1").split("\r\n")[1:])}
    return fields, http, payload


def inflate(stream, chunk: int = _CHUNK) -> Iterator[bytes]:
    """Inflated bytes of a gzip file, of one member or of many, front to back."""
    z = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if z.unconsumed_tail:
        yield z.flush()


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The records of an inflated archive; holds no more than one record and one part."""
    held = bytearray()
    done = False
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            fields, start = headers(bytes(held[: end + 4]))
            size = start + int(fields["content-length"]) + 4
            if len(held) >= size:
                yield bytes(held[:size])
                del held[:size]
                continue
        if done:
            if held.strip():
                raise ValueError("the archive ends inside a record")
            return
        more = next(parts, None)
        if more is None:
            done = True
        else:
            held += more


def gzipped(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def with_responses(pages: DataFrame, least: int = 1000, salts: int = 16) -> DataFrame:
    """page_id, url, html, refers_to of every page. Only digests and ids are grouped; texts are joined once, by page and
    digest, so copies of one payload lie evenly over the cluster. `salts` deals the ids of one digest over tasks."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    long = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    same = long.groupBy("digest").agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least")).where("kept <> least").select("digest", "kept")
    dealt = same.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    refers = long.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int")).join(dealt, ["digest", "salt"])
    refers = refers.where("kept <> page_id").select("page_id", "digest", F.col("kept").alias("refers_to"))
    return rows.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, html, refers_to) into one whole-file gzip archive a partition: archive, records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = z = None
        uri, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
        for pdf in batches:
            for page, url, html, refers in zip(pdf["page_id"].astype(object), pdf["url"], pdf["html"], pdf["refers_to"].astype(object), strict=True):
                if out is None:
                    system, path = opened(uri)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out, z = system.open_output_stream(path, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                own = lambda x: None if x is None or x != x else int(x)
                out.write(z.compress(build(own(page), url or None, as_bytes(html), own(refers), date)))
                n += 1
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pd.DataFrame({"archive": [uri], "records": [n]})

    texts = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"))
    return texts.mapInPandas(run, "archive string, records long")


def normalise(archives: DataFrame, per_slice: int = 1000) -> DataFrame:
    """Rewrites each archive with one gzip member a record and writes its sidecar. One row for each `per_slice` records:
    archive (the new one), index, and where the slice starts and ends in the index."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["archive"]:
                new = f"{uri.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.members.warc.gz"
                (system, source), (_, target) = opened(uri), opened(new)
                at = n = lines = 0
                cuts = [0]
                with system.open_input_stream(source, compression=None) as src, system.open_output_stream(target, compression=None) as out, system.open_output_stream(f"{target}.idx", compression=None) as idx:
                    for record in records(inflate(src)):
                        fields, _ = headers(record)
                        member = gzipped(record)
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": fields["warc-type"], "id": fields["warc-record-id"], "uri": fields.get("warc-target-uri")}
                        entry = json.dumps(line).encode() + b"\n"
                        idx.write(entry)
                        at, n, lines = at + len(member), n + 1, lines + len(entry)
                        if n % per_slice == 0:
                            cuts.append(lines)
                if cuts[-1] < lines:
                    cuts.append(lines)
                yield pd.DataFrame({"archive": new, "index": f"{new}.idx", "start": cuts[:-1], "end": cuts[1:]})

    return archives.select("archive").mapInPandas(run, "archive string, index string, start long, end long")


def read(normalised: DataFrame) -> DataFrame:
    """Every record through slices of the sidecar index: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
        for pdf in batches:
            for uri, index, start, end in zip(pdf["archive"], pdf["index"], pdf["start"], pdf["end"], strict=True):
                (system, path), (_, sidecar) = opened(uri), opened(index)
                with system.open_input_file(sidecar) as lines:
                    lines.seek(start)
                    entries = [json.loads(x) for x in lines.read(end - start).splitlines()]
                rows = []
                with system.open_input_file(path) as f:
                    for entry in entries:
                        f.seek(entry["offset"])
                        fields, http, payload = parse(zlib.decompress(f.read(entry["length"]), 31))
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                        response = fields["warc-type"] == "response"
                        if response and hashlib.sha1(payload).digest() != digest:
                            raise ValueError(f"payload digest differs in {uri} at {entry['offset']}")
                        refers = None if response else str(page_of(fields["warc-refers-to"]))
                        page = page_of(fields["warc-record-id"])
                        rows.append((None if page is None else str(page), int(http["content-length"]), digest.hex(), fields["warc-type"], refers, fields.get("warc-target-uri"), payload if response else None))
                        if len(rows) == 500:
                            yield pd.DataFrame(rows, columns=cols)
                            rows = []
                yield pd.DataFrame(rows, columns=cols)

    out = normalised.select("archive", "index", "start", "end").mapInPandas(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def dealt_out(names: DataFrame, count: int, *keys: str) -> DataFrame:
    """One task for each of `count` rows, as far as the hash of the keys allows; at most 20 for each shuffle partition."""
    return names.repartition(max(1, min(count, 20 * partitions(names.sparkSession))), *keys)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes, normalises and reads back all pages."""
    folder = shared_dir(spark, "warc")
    written = stored(write(with_responses(pages, least), folder), "warc-written")
    slices = stored(normalise(dealt_out(written.select("archive"), 2 * written.count(), "archive")), "warc-normalised")
    return read(dealt_out(slices, slices.count(), "archive", "start"))
