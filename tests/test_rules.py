import datetime as dt
import threading
import time

import pytest
from pyspark.sql import functions as F
from siltstone.functions.layouts import lone_timestamp
from siltstone.functions.normalize import detect_value_type, structural_tokens
from siltstone.functions.sql import register
from siltstone.operators import explore as X
from siltstone.operators import rules as R
from siltstone.plans import pipeline as B


def rule_rows(spark, rows):
    return spark.createDataFrame([(h, "n" + h, p, None, None, "Active", "json", "", "", "", "", None, None, None, 0, None, None, None) for h, p in rows], B.RULES)


def test_rules_that_do_not_compile_go(spark):
    rules = rule_rows(spark, [("a", "^x$"), ("b", "("), ("c", ""), ("d", None), ("e", "(?=x)")])
    assert [r.hash for r in R.valid_rules(rules).collect()] == ["a"]


def test_patch_keeps_what_the_change_leaves_empty(spark):
    rules = rule_rows(spark, [("a", "x"), ("b", "y")])
    out = R.patched(rules, spark.createDataFrame([("a", "", "Inactive", 7)], "hash string, pattern string, status string, logs_processed long"))
    assert out.columns == rules.columns
    assert sorted((r.hash, r.pattern, r.status, r.logs_processed) for r in out.collect()) == [("a", "x", "Inactive", 7), ("b", "y", "Active", 0)]


def test_rows_go_by_key(spark):
    assert [r.hash for r in R.without(rule_rows(spark, [("a", "x"), ("b", "y")]), spark.createDataFrame([("a",), ("z",)], "hash string"), "hash").collect()] == ["b"]


def test_synthesiser_without_an_answer_falls_back(spark):
    missing = spark.createDataFrame([("h", "some text", "plain_text", "", "", "")], "fingerprint string, raw_log string, format string, vendor string, product string, template string")
    asked = R.synthesize(missing, lambda raw: F.lit(None).cast(R.RULE)).select("pattern").collect()
    assert asked == R.synthesize(missing).select("pattern").collect() and asked[0].pattern


def test_waiting_requests(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "a", "waiting_parser", 0, t), (2, "b", "waiting_parser", 0, t), (3, "b", "waiting_parser", 0, t + dt.timedelta(seconds=290)), (4, None, "waiting_parser", 1, t), (5, "a", "completed", 0, t)]
    requests = spark.createDataFrame(rows, "id long, fingerprint string, status string, attempts int, created_at timestamp")
    out = B.waiting_again(requests, rule_rows(spark, [("a", "x"), ("a", "z"), ("b", "")]), F.lit(t + dt.timedelta(seconds=400)))
    assert sorted((r.id, r.status, r.attempts) for r in out.collect()) == [(1, "pending", 0), (2, "failed", 1), (3, "waiting_parser", 0), (4, "failed", 2), (5, "completed", 0)]


def test_tokens_of_empty_and_bare_words(spark):
    rows = spark.createDataFrame([(1, ""), (2, "(a): [] {b}, 'c\"d'"), (3, None)], "i int, t string").select("i", structural_tokens(F.col("t")).alias("w"))
    assert {r.i: r.w for r in rows.collect()} == {1: [], 2: ["a", "b", 'c"d'], 3: None}


@pytest.mark.parametrize("text", ["", "2024", "2024-13-01 00:00:00", "2024-01-01 00:00:00 x", None])
def test_no_timestamp(text):
    assert lone_timestamp(text) is None


def test_functions_in_sql(spark):
    register(spark)
    assert spark.sql("SELECT extract_timestamp('2024-05-06 07:08:09')").first()[0] == "2024-05-06T07:08:09Z"
    assert spark.sql("SELECT log_features('a=1 b=x', false).tail").first()[0] == "|fields=a:number,b:string"
    parsed = spark.sql("SELECT parse_log('u7', '^u(?P<n>[0-9]+)$', map('n', 'metadata.n'), cast(null as map<string,struct<type:string,format:string>>)) AS p").first().p
    assert parsed.error is None and parsed.normalized.metadata == {"n": "7"}


def test_both_value_types_agree(spark):
    register(spark)
    words = ["", " ", "1", "-1.5e3", "0x1f", "inf", "NaN", "1e999", "10.0.0.1", "300.1.1.1", "::1", "fe80::1%eth0", "a@b.co", "a@b", "2024-01-02T03:04:05Z", "2024-01-02 03:04:05", "12:34:56", "1700000000", "1700000000000", "true", "FALSE", "null",
             "550e8400-e29b-41d4-a716-446655440000", "deadbeefdeadbeefdeadbeefdeadbeef", "/usr/bin", "http://x.y/z", "00:1a:2b:3c:4d:5e", "é", "x" * 5000, "Jan  2 03:04:05", "02/Jan/2024:03:04:05 +0000"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", detect_value_type(F.col("w")).alias("a"), F.expr("detect_value_type(w)").alias("b"))
    assert [r for r in rows.collect() if r.a != r.b] == []


def test_first_log_and_totals(spark):
    requests = spark.createDataFrame([(1, 5, "pending", "raw one"), (2, 5, "failed", "")], "id long, user_id long, status string, raw_log string")
    logs = spark.createDataFrame([], "id long, hash string, normalized struct<severity:string,service:string,message:string>")
    assert sorted(tuple(r) for r in X.first_logs(requests, logs).select("id", "level", "service", "message").collect()) == [(1, "—", "—", "raw one"), (2, "—", "—", "—")]
    assert X.count_of(requests, 5, "failed").first().total == 1 and X.count_of(requests, 6).first().total == 0
    assert [r.id for r in X.request_of(requests, 2, 5).collect()] == [2] and X.request_of(requests, 2, 6).count() == 0


def test_upsert_keeps_what_says_nothing_and_names_the_nameless(spark):
    at, later = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    base = {f.name: None for f in B.no_rules(spark).schema.fields}
    one = lambda **x: tuple((base | x).values())
    new = [one(hash="a" * 64, name="", pattern="p", status="", format="json", vendor="", product="", extracted_fields=["k"], delimiter=",", sample_log="s", logs_processed=0)]
    rules = R.upsert(B.no_rules(spark), spark.createDataFrame(new, B.RULES), F.lit(at))
    r = rules.first()
    assert (r.name, r.status, r.created_at, r.updated_at, r.last_used) == ("jsonParser", "Active", at, at, at)
    change = [one(hash="a" * 64, name="", pattern="q", status="Inactive", format="unknown", vendor="acme", product="", extracted_fields=[], delimiter="", sample_log="", logs_processed=9)]
    r = R.upsert(rules, spark.createDataFrame(change, B.RULES), F.lit(later)).first()
    assert (r.name, r.pattern, r.status, r.vendor, r.extracted_fields, r.delimiter, r.sample_log) == ("acmeParser", "q", "Inactive", "acme", ["k"], ",", "s")
    assert (r.logs_processed, r.created_at, r.updated_at) == (0, at, later)


def test_a_pattern_that_does_not_compile_falls_back(spark):
    missing = spark.createDataFrame([("h", "some text", "plain_text", "", "", "")], "fingerprint string, raw_log string, format string, vendor string, product string, template string")
    broken = lambda raw: F.struct(F.lit("n").alias("name"), F.lit("(").alias("pattern"), F.lit(None).cast("map<string,string>").alias("mapping"), F.lit(None).cast("map<string,struct<type:string,format:string>>").alias("transformations"))
    assert R.synthesize(missing, broken).first().pattern == R.synthesize(missing).first().pattern


def test_processing_counts_usage(spark):
    rows = [(i, 1, f"alpha {i} one", "pending", 0, dt.datetime(2024, 1, 1)) for i in range(5)]
    requests = spark.createDataFrame(rows, "id long, user_id long, raw_log string, status string, attempts int, created_at timestamp_ntz")
    first = B.process(requests, B.no_rules(spark))
    again = B.process(requests.where("id < 2"), first.rules)
    assert [r.logs_processed for r in first.rules.collect()] == [5] and [r.logs_processed for r in again.rules.collect()] == [7]


def test_remote_synthesiser_answers_fails_or_hangs(spark, tmp_path):
    log = str(tmp_path / "calls")

    def hook(raw, features):
        with open(log, "a") as f:
            f.write(raw + "\n")
        if raw == "hangs":
            threading.Event().wait()
        if raw == "fails":
            raise ValueError("no")
        return {"answers": {"name": "own", "pattern": "^(?P<message>answers)$", "mapping": {"message": "message"}, "transformations": {"message": {"type": "upper"}}}, "broken": {"name": "x", "pattern": "("}, "odd": {"name": 5}}.get(raw)

    names = ["answers", "fails", "hangs", "broken", "odd", "none"]
    missing = spark.createDataFrame([(n, n, "plain_text", "", "", "") for n in names], "fingerprint string, raw_log string, format string, vendor string, product string, template string").coalesce(2)
    began = time.time()
    made = {r["hash"]: r for r in R.synthesize(missing, R.Remote(hook, seconds=1, in_flight=2)).collect()}
    assert time.time() - began < 60
    assert made["answers"].name == "own" and made["answers"].transformations["message"]["type"] == "upper"
    assert all(made[n].pattern == "^(?P<message>.*)$" and made[n].name == "" for n in names[1:])
    assert sorted(open(log).read().split()) == sorted(names)  # one call each
