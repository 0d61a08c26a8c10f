import gzip
import hashlib
import io

import duckdb
from pyspark.sql import functions as F
from siltstone.llm import queries as q
from siltstone.llm import warc


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view pages as from '{sf}/pages.parquet'")
    want = con.execute(q.oracle_sql()["op8_warc"]).fetchall()
    got = q.queries()["op8_warc"](spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len(got) == 250


def test_odd_pages(spark):
    big = "é" * 600
    rows = [(5, "http://a/ b\r\nX", big), (9, None, big), (-3, "u", big), (None, "u", big), (9, "u", big), (1, "", None), (2, "u", ""), (3, "u", "s" * 900), (4, "u", "s" * 900), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(spark, df).collect()), key=str)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        refers = 9 if html == big and page not in (9, None) else None
        want.append((page, "revisit" if refers else "response", refers, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_inflate_and_records_over_small_parts():
    made = [warc.build(k, "u", b"x" * k, None, "d") for k in range(40)]
    for data in (gzip.compress(b"".join(made)), b"".join(map(gzip.compress, made))):
        assert list(warc.records(warc.inflate(io.BytesIO(data), 7))) == made


def test_reading_and_copies_are_spread(spark):
    df = spark.createDataFrame([(k, "u", "z" * 1200 if k % 3 else f"{k}" * 400) for k in range(600)], "page_id long, url string, html string")
    rows = warc.with_responses(df).repartition(2, "page_id")
    assert rows.where("refers_to = 599").count() == 399
    folder = warc.shared_dir(spark, "warc-test")
    written = warc.stored(warc.write(rows, folder), "warc-written")
    slices = warc.stored(warc.normalise(written, per_slice=50), "warc-slices")
    assert slices.count() >= 12
    read = warc.read(warc.dealt_out(slices, slices.count(), "archive", "start"))
    assert read.rdd.getNumPartitions() >= 12 and read.count() == 600
    assert read.groupBy(F.spark_partition_id()).count().count() > 4
