import functools
import hashlib
import random

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from samples import CANONICAL, MALFORMED, SSHD, SSHD_FINGERPRINT
from siltstone.functions import normalize as N
from siltstone.functions import patterns as P
from siltstone.functions import structure as S
from siltstone.functions.features import with_fingerprint
from siltstone.functions.sql import features_view


def test_canonical_forms_and_malformed_logs(spark):
    logs = [raw for raw, _ in CANONICAL] + [SSHD] + MALFORMED
    df = spark.createDataFrame([(i, raw, "mine", "mine") for i, raw in enumerate(logs)], "id int, raw_log string, _t string, `_row` string")
    out = with_fingerprint(df)
    assert out.columns[:4] == df.columns
    rows = out.orderBy("id").collect()
    for r, (raw, want) in zip(rows, CANONICAL, strict=False):
        assert r.canonical == want, raw
        assert r.fingerprint == hashlib.sha256(want.encode()).hexdigest() and r["_t"] == r["_row"] == "mine"
    assert rows[len(CANONICAL)].fingerprint == SSHD_FINGERPRINT
    assert len(rows) == len(logs) and all(len(r.fingerprint) == 64 for r in rows)


CASES = [
    ('{"a":1} {"b":2}', None), ('[1,"a"]', "fp-v1:format=json|schema=array[number]"),
    ('[{"a":1},{"b":"x"}]', "fp-v1:format=json|schema=array[object{a:number,b:string}]"),
    (",,,,", "fp-v1:format=csv|delim=,|cols=5|header=true|headers=,,,,|types=string,string,string,string,string"),
    ("one, two, three, four", "fp-v1:format=csv|delim=,|cols=4|header=true|headers=one,two,three,four|types=string,string,string,string"),
    ("<191>x", "fp-v1:format=syslog|ver=0|fac=23|sev=7|app=|msg_id=|template=x"), ("<192>x", "fp-v1:format=plain_text|template=<192>x"),
    ("k=à b=c", None), ("é2026-01-01", "fp-v1:format=plain_text|template=é<DATE>"),
    ("CEF:0|a\\|b|c|d|e|f|g", "fp-v1:format=cef|vendor=a|b|product=c|ver=0|dev_vendor=a|b|dev_product=c|dev_ver=d|class_id=e|sev=g|ext="),
    ("user=7 status=200 size=123 ratio=1e999 x=", "fp-v1:format=key_value|fields=ratio:string,size:number,status:number,user:number,x:string"),
    ("Aug 30 13:02:11 h app[1]: up", "fp-v1:format=syslog|ver=0|fac=0|sev=0|app=app|msg_id=|template=up"),
]


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "id int, raw_log string")
    for r, (raw, want) in zip(with_fingerprint(df).orderBy("id").collect(), CASES, strict=True):
        assert want is None or r.canonical == want, raw
    assert S.json_schema('{"a":1} {"b":2}') == "|schema=object{a:number}"


PAIRS = [
    ('{"a":"10.0.0.1","n":1}', '{"n":22,"a":"8.8.8.8"}'), ("a=1 b=x", "b=y, a=7"),
    ("Failed login for user bob from 10.0.0.1", "Failed login for user al from 1.2.3.4"),
    ('t="x y" n=5', "n=77 t='z'"), ("2026-01-01 10:00:00 took 5 sec", "2027-03-04 11:22:33 took 99 sec"),
]


def test_volatile_values_keep_the_hash(spark):
    df = spark.createDataFrame([(i, s) for i, p in enumerate(PAIRS) for s in p], "id int, raw_log string")
    n = with_fingerprint(df).groupBy("id").agg(F.countDistinct("fingerprint").alias("n")).collect()
    assert all(r.n == 1 for r in n)


VALUES = ["", " ", "true", "No", "nil", "550e8400-e29b-41d4-a716-446655440000", "00:1b:44:11:3a:b7", "10.0.0.1", "010.0.0.1", "256.1.1.1", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2", "a" * 32, "http://x", "see a@b.co now", "2026-01-01T00:00:00Z", "13:02:11", "at 13:02:11.123456", "1500000000", "1500000000000", "12", "-1.5e3", "1e999", "inf", "NaN", "+nan", "0x10", "0x1p4", "1_000", "1d", "x", "12:34:56 é"]


def test_value_types_agree(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = {r.v: r.t for r in df.select("v", N.detect_value_type(F.col("v")).alias("t")).collect()}
    assert got == {v: S.value_type(v) for v in VALUES}
    assert [got[v] for v in ("10.0.0.1", "010.0.0.1", "::1", "1e999", "inf", "0x10", "1d", "13:02:11")] == ["ipv4", "string", "ipv6", "string", "number", "string", "string", "time"]


@pytest.mark.parametrize("name", [s[0] for s in P.STEPS])
def test_steps_equal_re2(spark, name):
    """DuckDB's engine is RE2: every step over all documents."""
    _, pattern, replacement = next(s for s in P.STEPS if s[0] == name)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.register("t", texts)
    want = con.execute("select doc_id, regexp_replace(text, ?, ?, 'g') from t order by 1", [pattern, replacement]).fetchall()
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    c = F.col("text")
    got = df.select("doc_id", F.when(N.is_ascii(c), N.step(c, pattern, replacement)).otherwise(N.step(c, pattern, replacement, False))).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_long_texts_are_cut(spark):
    df = spark.createDataFrame([("x" * 4095 + "é",), ("a 5 b",)], "t string")
    got = [r[0] for r in df.select(N.normalize_template(F.col("t"))).collect()]
    assert got[0].endswith(" <TRUNCATED>") and got[1] == "a <NUMBER> b"


RECORDS = [
    ('{"b":{"x":1},"a":[1],"ip":"10.0.0.1"}', {"field_count": 3, "keys": ["a", "b", "ip"], "types": ["array", "object", "ipv4"], "json_schema": "object{a:array[number],b:object{x:number},ip:ipv4}"}),
    ("[1, 2]", {"field_count": 0, "keys": [], "json_schema": "array[number]"}),
    ("k='x y',b=1,k=2,c=3", {"field_count": 3, "keys": ["b", "c", "k"], "delimiter": ",", "kv": ("=", ",", "single", True)}),
    ('a: 1 b="2 3"', None),
    ("one,Two,Three,Four\n1,2,3,10.0.0.1", None),
    ("<13>hi there", {"field_count": 0, "tokens": [], "syslog": (0, 1, 5, "", False, False, False)}),
    ("Aug 30 13:02:11 h app: up", {"field_count": 3, "tokens": ["syslog", "bsd", "app"], "syslog": (0, 0, 0, "app", True, True, False)}),
    ('<46>1 - - grinder - - [a@1 x="1"][b@2 y="2"] on', {"field_count": 7, "keys": ["a@1.x", "b@2.y"], "syslog": (1, 5, 6, "grinder", False, False, False)}),
    ('Traceback (most recent call last):\n  File "a.py", line 3\nValueError: bad', {"field_count": 3, "multiline": (3, True, "python_stack")}),
    ("goroutine 7 [running]:\nmain.main()\n\tat x", {"multiline": (3, True, "java_stack")}),
    ("LEEF:2.0|A|B|1|E|x09|k=1\tz=2", {"field_count": 7, "keys": ["k", "z"], "delimiter": "|"}),
    ("", {"field_count": 0, "keys": [], "tokens": []}),
]


def test_feature_records(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(RECORDS)], "id int, raw_log string")
    df.createOrReplaceTempView("some_logs")
    rows = spark.sql(f"SELECT id, fingerprint, features FROM {features_view(spark, 'some_logs')} ORDER BY id").collect()
    plain = {r.id: r.fingerprint for r in with_fingerprint(df).collect()}
    subs = {"syslog": ("version", "facility", "severity", "app_name", "has_timestamp", "has_hostname", "has_pid"), "multiline": ("line_count", "is_stack_trace", "prefix_type"), "kv": ("separator", "delimiter", "quoting_style", "has_duplicates")}
    for r, (raw, want) in zip(rows, RECORDS, strict=True):
        f = r.features
        assert r.fingerprint == plain[r.id] and f.version == "fp-v1"
        assert sum(getattr(f, x) is not None for x in ("syslog", "cef", "leef", "csv", "kv", "multiline")) <= 1
        for name, value in (want or {}).items():
            if name in subs:
                assert tuple(getattr(getattr(f, name), x) for x in subs[name]) == value, raw
            elif name == "types":
                assert [x.type for x in f.field_signatures] == value
            else:
                assert getattr(f, "structural_tokens" if name == "tokens" else name) == value, (raw, name)


def test_steps_left_out_change_nothing(spark):
    """Random mixes of what the steps look for: the gated fold equals the plain chain of all steps."""
    rng = random.Random(11)
    parts = ["2026-01-02", "T10:11:12Z", " ", "  ", "-", ":", "::1", "10.0.0.1", "/24", ":80", "user", "User bob", "host ", "port 22", "a@b.co", "x://y", "http://q/z", "0xAF", "1500000000123", "sha256:", "MD5:ab", "Aug  3 10:00:00", "[", "]", "aa:bb:cc:dd:ee:ff", "aabb.ccdd.eeff", "f" * 24, "e" * 40, "d" * 64, "svc-7", "x_1", "é", "\t", ",", '"curl/8 z"', "550e8400-e29b-41d4-a716-446655440000", "fe80:1:2:3:4:5:6:7", " - bob [", "k=5", "nan", "1.5e3,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    c, chain = F.col("t"), lambda c, plain: functools.reduce(lambda x, s: N.step(x, s[1], s[2], plain), P.STEPS, c)
    every = F.array_join(F.transform(N.fields(F.col("all")), N.number_token), " ")
    rows = df.withColumn("all", F.when(N.is_ascii(c), chain(c, True)).otherwise(chain(c, False))).select("t", "all", N.steps(c).alias("gated"), every.alias("words"), N.normalize_template(c).alias("template"))
    assert [r for r in rows.collect() if r["all"] != r.gated or r.words != r.template] == []


def test_trimming_cuts_white_space_only(spark):
    got = spark.createDataFrame([("\x1cx\x1f",), ("\u3000 x\x85\xa0\t",)], "t string").select(N.trim_space(F.col("t"))).collect()
    assert [r[0] for r in got] == ["\x1cx\x1f", "x"] and S.value_type("\x1c1") == "string" and S.value_type("\u20031\u3000") == "number"
