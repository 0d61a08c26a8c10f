"""The same processing as three Structured Streaming queries that hand tables to each other below one folder.

    intake    new requests: known fingerprints are parsed, the others wait, and each unseen fingerprint is reported once a batch
    rules     reports: the first one of a fingerprint locks it for a while and makes its rule; later ones find the lock
    release   waiting requests: parsed as soon as their rule is there, failed when none came in time, else carried on

Every batch writes rows in proportion to itself: results, counters and rules are one folder a batch, overwritten when a
batch runs again, so a replay leaves one copy and counts once. What a batch read of the rules is written down first, so a
replay decides as the first attempt did. Request ids that come again within `redelivery` are taken once. Locks are keyed
state and hold one row for each fingerprint and batch, never the requests: those wait in tables and meet their rules in a
join, so a fingerprint with a third of all requests is an ordinary skewed join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.features import with_fingerprint
from siltstone.operators.rules import COLUMNS, default_rule, synthesize, upsert, valid_rules
from siltstone.plans.pipeline import RULES, eligible, representatives, settled, stored_logs
from siltstone.sources.scratch import exists, make_folder, materialized, remove

REQUESTS = "id long, user_id long, raw_log string, status string, attempts int, created_at timestamp_ntz"
WAITING = REQUESTS + ", fingerprint string, since timestamp"
MISSES = "fingerprint string, raw_log string, id long, at timestamp"
TABLES = ("requests", "logs", "usage", "waiting", "misses", "rules", "carried", "ticks", "seen")


def source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Requests that arrive as Parquet files; the file limit per trigger is the backpressure."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def prepare(spark: SparkSession, out: str) -> None:
    """The folders that the three queries read from each other."""
    for name in TABLES:
        make_folder(spark, f"{out}/{name}")


def rules_of(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The rules as their batches (up to one of them) left them: the latest row of each hash, if its pattern compiles."""
    rows = spark.read.schema(f"{RULES}, batch int").parquet(f"{out}/rules")
    rows = rows if upto is None else rows.where(F.col("batch") <= upto)
    last = rows.groupBy("hash").agg(F.max_by(F.struct(*COLUMNS), "batch").alias("r"))
    return valid_rules(last.select(*(F.col(f"r.{c}").alias(c) for c in COLUMNS)))


def rules_seen(spark: SparkSession, out: str, by: str, number: int) -> DataFrame:
    """The rules as a batch of a query finds them; a replayed batch finds the same."""
    path = f"{out}/seen/{by}-{number}"
    if not exists(spark, f"{path}/_SUCCESS"):
        newest = spark.read.schema(f"{RULES}, batch int").parquet(f"{out}/rules").agg(F.coalesce(F.max("batch"), F.lit(-1)).alias("upto"))
        newest.write.mode("overwrite").parquet(path)
    return rules_of(spark, out, spark.read.schema("upto int").parquet(path).first()["upto"])


def write_results(done: DataFrame, out: str, by: str, number: int, rest: DataFrame | None = None) -> None:
    """Requests, logs and counters of a batch of settled requests; the rest passes as it is."""
    at, columns = f"by={by}/batch={number}", ["id", "user_id", "raw_log", "status", "attempts", "created_at", "fingerprint"]
    requests = done.select(columns) if rest is None else done.select(columns).unionByName(rest.select(columns))
    requests.write.mode("overwrite").parquet(f"{out}/requests/{at}")
    stored_logs(done).write.mode("overwrite").parquet(f"{out}/logs/{at}")
    used = done.where("status = 'completed'").groupBy(F.col("fingerprint").alias("hash")).agg(F.count("*").alias("n"), F.current_timestamp().alias("at"))
    used.write.mode("overwrite").parquet(f"{out}/usage/{at}")


def _start(rows: DataFrame, batch, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def once(rows: DataFrame, redelivery: str) -> DataFrame:
    """Rows whose id has not come within the time; the time is that of arrival, so no row is ever late."""
    return rows.withColumn("_at", F.current_timestamp()).withWatermark("_at", redelivery).dropDuplicatesWithinWatermark(["id"]).drop("_at")


def intake(requests: DataFrame, out: str, checkpoint: str, available_now: bool = True, every: str = "5 seconds", redelivery: str = "1 hour") -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        marked = materialized(with_fingerprint(df), "fingerprints")
        taken = materialized(settled(eligible(marked), rules_seen(spark, out, "intake", number)), "parsed")
        rest = marked.where("not (status = 'pending' and attempts < 3)")
        waits = taken.where("status = 'waiting_parser'")
        waits.select("id", "user_id", "raw_log", "status", "attempts", "created_at", "fingerprint", F.current_timestamp().alias("since")).write.mode("overwrite").parquet(f"{out}/waiting/batch={number}")
        waits.groupBy("fingerprint").agg(F.min_by("raw_log", "id").alias("raw_log"), F.min("id").alias("id")).withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/misses/batch={number}")
        write_results(taken, out, "intake", number, rest)

    prepare(requests.sparkSession, out)
    return _start(once(requests, redelivery), batch, checkpoint, available_now, every)


def single_flight(misses: DataFrame, lock_seconds: float) -> DataFrame:
    """The reports (fingerprint, raw_log, id, at) that found no lock on their fingerprint; each sets one for some seconds.

    Time is that of the reports, so a replay decides alike; locks go an hour after they have expired.
    """

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at", "id"])  # one row for each batch of reports
        until = state.get[0] if state.exists else None
        for k, at in enumerate(rows["at"].astype("datetime64[us]").astype("int64")):
            if until is None or until <= at:
                until = int(at + lock_seconds * 1_000_000)
                yield rows.iloc[k : k + 1][["fingerprint", "raw_log", "id", "at"]]
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)

    return misses.withWatermark("at", "1 hour").groupBy("fingerprint").applyInPandasWithState(take, MISSES, "until long", "append", GroupStateTimeout.EventTimeTimeout)


def rule_maker(spark: SparkSession, out: str, checkpoint: str, rule=default_rule, available_now: bool = True, every: str = "5 seconds", lock_seconds: float = 300) -> StreamingQuery:
    """Makes the rules of reported fingerprints, each once while its lock holds; a rule that is there stays (recheck)."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        jobs = materialized(df, "jobs")
        known = rules_seen(spark, out, "rules", number)
        missing = jobs.join(known, jobs["fingerprint"] == known["hash"], "left_anti")
        made = synthesize(representatives(missing), rule)
        upsert(known.limit(0), made).write.mode("overwrite").parquet(f"{out}/rules/batch={number}")

    prepare(spark, out)
    return _start(single_flight(spark.readStream.schema(f"{MISSES}, batch int").parquet(f"{out}/misses").drop("batch"), lock_seconds), batch, checkpoint, available_now, every)


def release(spark: SparkSession, out: str, checkpoint: str, available_now: bool = True, every: str = "5 seconds", wait_seconds: float = 600, redelivery: str = "1 hour") -> StreamingQuery:
    """Settles waiting requests. Their arrival, new rules and ticks start a batch; what still waits is carried to the next."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = materialized(df.where("id is not null"), "waiting").withColumns({"status": F.lit("pending")})
        before = spark.read.schema(WAITING).parquet(f"{out}/carried/{number - 1}") if number and exists(spark, f"{out}/carried/{number - 1}") else None
        pool = new if before is None else new.unionByName(before)
        done = materialized(settled(pool, rules_seen(spark, out, "release", number)), "released")
        late = F.unix_millis(F.current_timestamp()) - F.unix_millis("since") > wait_seconds * 1000
        waits = F.col("status") == "waiting_parser"
        done = materialized(done.withColumns({"attempts": F.col("attempts") + F.when(waits & late, 1).otherwise(0), "status": F.when(waits & late, "failed").otherwise(F.col("status"))}), "released")
        done.where("status = 'waiting_parser'").select(pool.columns).withColumn("status", F.lit("pending")).write.mode("overwrite").parquet(f"{out}/carried/{number}")
        write_results(done.where("status <> 'waiting_parser'"), out, "release", number)
        if number > 1:  # the table before the last is of no use to a replay
            remove(spark, f"{out}/carried/{number - 2}")

    prepare(spark, out)
    waiting = once(spark.readStream.schema(f"{WAITING}, batch int").parquet(f"{out}/waiting").drop("batch"), redelivery)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in waiting.schema.fields]
    starts = [spark.readStream.schema("hash string, batch int").parquet(f"{out}/rules").select(*blank), spark.readStream.schema("at timestamp").parquet(f"{out}/ticks").select(*blank)]
    if not available_now:
        starts.append(spark.readStream.format("rate").option("rowsPerSecond", 1).option("numPartitions", 1).load().select(*blank))
    rows = waiting
    for s in starts:
        rows = rows.unionByName(s)
    return _start(rows, batch, checkpoint, available_now, every)


def tick(spark: SparkSession, out: str) -> None:
    """Starts a batch of release() that would otherwise find nothing new, so that waiting requests can expire."""
    prepare(spark, out)
    spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{out}/ticks")


def run(requests: DataFrame, out: str, checkpoint: str, rule=default_rule, **times) -> None:
    """Everything that is there now: intake, rules and release, one after the other. times: redelivery, lock_seconds, wait_seconds."""
    spark = requests.sparkSession
    pick = lambda *names: {k: v for k, v in times.items() if k in names}
    intake(requests, out, f"{checkpoint}/intake", **pick("redelivery")).awaitTermination()
    rule_maker(spark, out, f"{checkpoint}/rules", rule, **pick("lock_seconds")).awaitTermination()
    tick(spark, out)
    release(spark, out, f"{checkpoint}/release", **pick("wait_seconds", "redelivery")).awaitTermination()


def latest(spark: SparkSession, out: str, table: str) -> DataFrame:
    """requests or logs over all batches, one row an id: a release goes before the waiting that intake wrote, an earlier
    batch before a later one of a request that came again after its time."""
    rows = spark.read.parquet(f"{out}/{table}")
    first = rows.groupBy("id").agg(F.min(F.struct(F.when(F.col("by") == "release", 0).otherwise(1).alias("o"), "batch", "by")).alias("_f"))
    kept = first.select("id", F.col("_f.by").alias("by"), F.col("_f.batch").alias("batch"))
    return rows.join(kept, ["id", "by", "batch"]).drop("by", "batch")


def rules_with_usage(spark: SparkSession, out: str) -> DataFrame:
    """The rules with their counters: the sum over the batches' own counts."""
    counts = spark.read.schema("hash string, n long, at timestamp").parquet(f"{out}/usage").groupBy("hash").agg(F.sum("n").alias("_n"), F.max("at").alias("_at"))
    rows = rules_of(spark, out).join(counts, "hash", "left")
    moved = {"logs_processed": F.col("logs_processed") + F.coalesce("_n", F.lit(0)), "last_used": F.greatest("_at", "last_used")}
    return rows.withColumns(moved).select(*COLUMNS)


def stop(*queries: StreamingQuery, seconds: int = 10) -> bool:
    """Ends queries after their running batch; false where one is still active after the time."""
    for q in queries:
        q.stop()
    return all(q.awaitTermination(seconds) for q in queries)
