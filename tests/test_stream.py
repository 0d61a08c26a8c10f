import datetime as dt
import time

import pytest
from pyspark.sql import functions as F
from siltstone.operators.rules import RULE, default_rule
from siltstone.plans.pipeline import no_rules
from siltstone.streaming import stream as S

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture
def world(spark, tmp_path):
    """Folders of a stream, and a function that delivers requests as one more file."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.range(0).selectExpr("id", "id as user_id", "'' as raw_log", "'' as status", "0 as attempts", "timestamp_ntz'2024-01-01' as created_at").write.parquet(f"{tmp_path}/in")

    def deliver(*rows):
        full = [(i, 7, raw, "pending", 0, NOW) for i, raw in rows]
        spark.createDataFrame(full, S.REQUESTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    yield str(tmp_path), deliver
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def intake(spark, base, **options):
    S.intake(S.source(spark, f"{base}/in"), f"{base}/out", f"{base}/state/intake", **options).awaitTermination()


def rules(spark, base, **options):
    S.rule_maker(spark, f"{base}/out", f"{base}/state/rules", **options).awaitTermination()


def release(spark, base, **options):
    S.tick(spark, f"{base}/out")
    S.release(spark, f"{base}/out", f"{base}/state/release", **options).awaitTermination()


def statuses(spark, base):
    return {r.id: (r.status, r.attempts) for r in S.latest(spark, f"{base}/out", "requests").collect()}


def test_waiting_requests_come_back_expire_and_survive_restarts(spark, world):
    base, deliver = world
    deliver((1, "alpha one"), (2, "beta 5 two"), (3, "alpha one"))
    intake(spark, base)
    assert statuses(spark, base) == {i: ("waiting_parser", 0) for i in (1, 2, 3)}
    assert spark.read.parquet(f"{base}/out/misses").count() == 2  # one report a fingerprint
    release(spark, base, wait_seconds=3600)  # no rule yet: all are carried on
    assert set(statuses(spark, base).values()) == {("waiting_parser", 0)}
    deliver((4, "gamma, not made"))
    only = lambda raw: F.when(~raw.startswith("gamma"), default_rule(raw))
    rules(spark, base, rule=only)  # each call starts the queries anew from their checkpoints
    release(spark, base, wait_seconds=3600)
    assert {k: v[0] for k, v in statuses(spark, base).items()} == {1: "completed", 2: "completed", 3: "completed"}
    intake(spark, base)
    assert statuses(spark, base)[4] == ("waiting_parser", 0)
    time.sleep(1.1)
    release(spark, base, wait_seconds=1)
    assert statuses(spark, base)[4] == ("failed", 1)
    deliver((5, "alpha one"))
    intake(spark, base)  # the rule is known: no waiting
    assert statuses(spark, base)[5] == ("completed", 0)
    made = {r.sample_log: r.logs_processed for r in S.rules_with_usage(spark, f"{base}/out").collect()}
    assert made == {"alpha one": 3, "beta 5 two": 1}


def test_redelivery_and_replay_count_once(spark, world):
    base, deliver = world
    deliver((1, "alpha one"), (1, "alpha one"), (2, "alpha one"))
    S.run(S.source(spark, f"{base}/in"), f"{base}/out", f"{base}/state")
    deliver((2, "alpha one"), (3, "alpha one"))
    intake(spark, base)
    sizes = {r.batch: r["count"] for r in spark.read.parquet(f"{base}/out/requests").where("by = 'intake'").groupBy("batch").count().collect()}
    assert sorted(sizes.values()) == [1, 2]  # request 2 came again and was left out
    last = max(sizes)
    done = spark.read.parquet(f"{base}/out/logs")
    before = S.rules_with_usage(spark, f"{base}/out").collect()
    assert done.count() == 3 and [r.logs_processed for r in before] == [3]
    rows = done.where(f"by = 'intake' and batch = {last}")
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    again = kept.select("id", "user_id", "raw_log", F.lit("completed").alias("status"), F.lit(0).alias("attempts"), F.col("request_created_at").alias("created_at"), F.col("hash").alias("fingerprint"), "normalized")
    S.write_results(again, f"{base}/out", "intake", last)  # the batch runs again
    assert [r.logs_processed for r in S.rules_with_usage(spark, f"{base}/out").collect()] == [3]
    assert S.latest(spark, f"{base}/out", "logs").count() == 3


def test_one_flight_a_fingerprint_until_its_lock_expires(spark, world):
    base, deliver = world
    calls = lambda: spark.read.parquet(f"{base}/out/rules").groupBy("batch").count().collect()
    deliver(*((i, "alpha one") for i in range(100)))
    intake(spark, base)
    rules(spark, base, lock_seconds=300)
    assert [r["count"] for r in calls()] == [1]
    locked = spark.createDataFrame([("f", "x", i, NOW + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 290, 301, 400, 700))], S.MISSES)
    locked.coalesce(1).write.mode("overwrite").parquet(f"{base}/reports")
    q = S.single_flight(spark.readStream.schema(S.MISSES).parquet(f"{base}/reports"), 300).writeStream.format("memory").queryName("jobs").option("checkpointLocation", f"{base}/state/jobs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.id for r in spark.table("jobs").orderBy("id").collect()] == [0, 3, 5]


def test_rules_of_a_synthesiser_without_answer_or_with_a_broken_pattern(spark, world):
    base, deliver = world
    deliver((1, "alpha one"), (2, "beta x y"))
    broken = lambda raw: F.when(raw.startswith("alpha"), F.struct(F.lit("n").alias("name"), F.lit("(").alias("pattern"), F.lit(None).cast("map<string,string>").alias("mapping"), F.lit(None).cast("map<string,struct<type:string,format:string>>").alias("transformations")).cast(RULE))
    S.run(S.source(spark, f"{base}/in"), f"{base}/out", f"{base}/state", rule=broken)
    assert {k: v[0] for k, v in statuses(spark, base).items()} == {1: "completed", 2: "completed"}
    assert S.rules_of(spark, f"{base}/out").schema.names == no_rules(spark).schema.names
