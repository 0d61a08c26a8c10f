"""Work that must not grow faster than its input, and the paths that keep it so."""

import time

import pytest
from pyspark.sql import functions as F
from siltstone.functions import normalize as N
from siltstone.functions import patterns as P
from siltstone.operators import parse as A
from siltstone.plans import queries as Q
from siltstone.sources import corpus
from siltstone.sources.scratch import materialized

SF = "/root/testdata/sf0.001"


def seconds(df) -> float:
    start = time.monotonic()
    df.write.format("noop").mode("overwrite").save()
    return time.monotonic() - start


def test_lone_steps_equal_plain_ones_and_pass_over_texts_without_a_match(spark):
    texts = [
        "up fe80::1 and 1:2:3:4:5:6:7:8, ::1 1:: at 10.0.0.1:80", "é fe80::1 10.0.0.1/24 x-1", 'u - bob [x] "curl/8.0 y" SHA256:ab from host h7 for user al port 22', "ftp://a/b a@b.co 2024-01-02T03:04:05Z 03/Feb/2024:03:04:05 Feb  3 03:04:05 2024/01/02 03:04:05",
        "7c9e6679-7425-40de-944b-e07fc1f90ae7 00:1b:44:11:3a:b7 001b.4411.3ab7 0xff 1700000000 1700000000123", " ".join("a1" * n for n in (12, 16, 20, 32)), "plain words: no more", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for name, pattern, replacement in P.STEPS:
        plain = F.when(N.is_ascii(c), N.step(c, pattern, replacement)).otherwise(N.step(c, pattern, replacement, False))
        rows = df.select(N.lone_step(c, name).alias("a"), plain.alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], name
        assert any(r.a != t for r, t in zip(rows, texts, strict=True)), name
    prose = spark.range(0, 3000, 1, 2).select(F.repeat(F.concat(F.lit("some words of prose 7 "), "id"), 60).alias("t"))
    name, pattern, replacement = next(s for s in P.STEPS if s[0] == "ipv6")
    seconds(prose.select(N.lone_step(c, name)))
    assert seconds(prose.select(N.lone_step(c, name))) < seconds(prose.select(N.step(c, pattern, replacement))) / 2


def test_a_task_has_a_bounded_number_of_logs(spark, monkeypatch):
    events = spark.read.parquet(f"{SF}/events.parquet")
    monkeypatch.setattr(corpus, "TASK_ROWS", 20)
    tasks = corpus.spread(events).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) == -(-events.count() // 20) > 8 and max(r["count"] for r in tasks) <= 40


@pytest.mark.parametrize("name, where", [("q_format_facet", "status = 'pending' and attempts < 3"), ("q_search_samples", "status = 'pending' and attempts < 3"), ("q_kv_signature", "k = 1"), ("q_text_template", "k = 5")])
def test_only_logs_that_a_query_asks_for_get_fingerprints(spark, monkeypatch, name, where):
    taken, make = [], Q.with_fingerprint
    monkeypatch.setattr(Q, "with_fingerprint", lambda df: (taken.append(df.count()), make(df))[1])
    Q.QUERIES[name](spark, SF)
    assert taken == [corpus.raw_logs(spark, SF).where(where).count()]


def test_a_part_of_the_feature_record_costs_no_template(spark):
    plan = Q.QUERIES["q_features_syslog"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "<TRUNCATED>" not in plan and "syslog" in plan


def test_value_types_try_few_forms(monkeypatch):
    from siltstone.functions import structure as S

    tried = []
    monkeypatch.setattr(S.ipaddress, "ip_address", lambda t: tried.append(t))
    assert [S.value_type.__wrapped__(v) for v in ("2024-01-02T03:04:05Z", "29.27", "12345")] == ["timestamp", "number", "number"] and tried == []


def test_first_rules_join_without_an_exchange_of_the_logs(spark):
    """q_collisions: few hashes, many logs; a hash's rules are read once."""
    upper = {"s": {"type": "upper", "format": None}}
    own = [("a", 2, "^(?P<message>.*)$", None, None), ("a", 1, r'^(?P<s>[a-z"]+) (?P<m>\S+)$', {"s": "severity", "m": "metadata.k\u00e9"}, upper), ("b", 1, "(", None, None), ("b", 3, "b+", {}, {}), ("c", 1, None, None, None)]
    rules = spark.createDataFrame(own, A.T.StructType([*A.T._parse_datatype_string("hash string, rank int, pattern string, mapping map<string,string>").fields, A.T.StructField("transformations", A.TRANSFORMATIONS)]))
    texts = [("a", 'w"x 7'), ("a", "W 7"), ("a", "x\ny"), ("b", "bbb"), ("b", "abb"), ("c", "x"), ("d", "x"), (None, "x"), ("a", None)]
    logs = materialized(spark.createDataFrame([(f, r) for f, r in texts] * 4000, "fingerprint string, raw_log string").withColumn("id", F.monotonically_increasing_id()).withColumn("pad", F.sha2(F.col("id").cast("string"), 256)), "logs")
    rules = rules.join(logs.select(F.col("fingerprint").alias("hash")).distinct(), "hash")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        whole, choice = A.with_first_parsed(logs, rules), A.with_first_parsed(logs, rules, normalized=False)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (whole, choice)]
        found = {(r.fingerprint, r.raw_log): r for r in whole.dropDuplicates(["fingerprint", "raw_log"]).collect()}
        chosen = choice.groupBy("fingerprint", "raw_log", "candidate", "error").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert all("BroadcastHashJoin" in p and "hashpartitioning" not in p for p in plans)
    bad = A.parse_one("", "(", {}, {})[1]
    want = [(1, None), (2, None), (None, "no match"), (2, None), (None, bad), (None, "no rule"), (None, "no rule"), (None, "no rule"), (2, None)]
    assert [(found[t].candidate, found[t].error) for t in texts] == want
    assert {(r.fingerprint, r.raw_log): (r.candidate, r.error) for r in chosen} == dict(zip(texts, want, strict=True)) and {r["count"] for r in chosen} == {4000}
    assert (found[texts[0]].normalized.severity, found[texts[0]].normalized.metadata) == ('W"X', {"k\u00e9": "7"}) and found[texts[1]].normalized.message == "W 7"
    assert found[texts[2]].normalized is None and "normalized" not in choice.columns
