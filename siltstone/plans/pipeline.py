"""Batch processing of requests: fingerprint, join rules, make rules for unseen fingerprints once, parse."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.features import with_fingerprint
from siltstone.operators.parse import with_parsed
from siltstone.operators.rules import count_usage, default_rule, synthesize, upsert
from siltstone.sources.scratch import materialized

RULES = "hash string, name string, pattern string, mapping map<string,string>, transformations map<string,struct<type:string,format:string>>, status string, format string, vendor string, product string, template string, delimiter string, extracted_fields array<string>, field_signatures array<struct<key:string,type:string>>, sample_log string, logs_processed long, last_used timestamp, created_at timestamp, updated_at timestamp"


class Processed(NamedTuple):
    requests: DataFrame
    logs: DataFrame
    rules: DataFrame


def no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULES)


#: What the next run takes up: pending and tried less than three times.
ELIGIBLE = "status = 'pending' and attempts < 3"


def eligible(requests: DataFrame) -> DataFrame:
    return requests.where(ELIGIBLE)


def usable(rules: DataFrame, only_active: bool = False) -> DataFrame:
    found = rules.where("pattern <> ''")
    return found.where("lower(status) = 'active'") if only_active else found


def unmatched(logs: DataFrame, rules: DataFrame) -> DataFrame:
    return logs.join(rules, logs["fingerprint"] == rules["hash"], "left_anti")


def representatives(logs: DataFrame) -> DataFrame:
    """One log per fingerprint, the one with the smallest id, with its feature record: a rule is made once, whatever number
    waits for it. Materialised: filters on what is made of a record would otherwise take the log apart again."""
    one = logs.groupBy("fingerprint").agg(F.min_by("raw_log", "id").alias("raw_log"))
    return materialized(with_fingerprint(one.select("raw_log"), record=True), "representatives")


def settled(logs: DataFrame, rules: DataFrame, only_active: bool = False) -> DataFrame:
    """Fingerprinted requests with normalized, error, status and attempts as the rules settle them; those without a rule wait.

    The join with the rules is left to Spark's choice by size.
    """
    known = usable(rules, only_active).select(F.col("hash").alias("_hash"), "pattern", "mapping", "transformations")
    parsed = with_parsed(logs.join(known, logs["fingerprint"] == known["_hash"], "left"))
    ok, waits = F.col("error").isNull(), F.col("_hash").isNull()
    status = F.when(waits, "waiting_parser").when(ok, "completed").otherwise("failed")
    attempts = F.col("attempts") + F.when(waits | ok, 0).otherwise(1)
    return parsed.withColumns({"status": status, "attempts": attempts.cast(logs.schema["attempts"].dataType)}).drop("_hash", "pattern", "mapping", "transformations")


def stored_logs(done: DataFrame) -> DataFrame:
    """Log rows of the completed ones among settled requests."""
    user = F.col("user_id") if "user_id" in done.columns else F.lit(None).cast("long")
    return done.where("status = 'completed'").select("id", user.alias("user_id"), F.lit(False).alias("is_direct"), F.col("created_at").alias("request_created_at"), "normalized", "raw_log", F.col("fingerprint").alias("hash"))


def process(requests: DataFrame, rules: DataFrame, rule=default_rule, only_active: bool = False) -> Processed:
    """Processes the eligible requests (id, raw_log, status, attempts, created_at); others pass through. Rules come back with
    their counters moved on. Fingerprints are materialised once for both of their uses."""
    taken = eligible(requests)
    marked = materialized(with_fingerprint(taken), "fingerprints")
    missing = representatives(unmatched(marked, usable(rules, only_active)))
    all_rules = materialized(upsert(rules, synthesize(missing, rule)), "rules")
    done = materialized(settled(marked, all_rules, only_active), "parsed")
    rest = requests.where("not (status = 'pending' and attempts < 3)")
    used = done.where("status = 'completed'").select("fingerprint", F.current_timestamp().alias("at"))
    return Processed(done.select(requests.columns).unionByName(rest), stored_logs(done), count_usage(all_rules, used))


def waiting_again(requests: DataFrame, rules: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Requests that wait for a rule (status waiting_parser, with fingerprint and created_at): pending again where the rule
    has come, failed with one more attempt where none came in time; all others as they are."""
    known = usable(rules).select(F.col("hash").alias("fingerprint"), F.lit(True).alias("_known")).distinct()
    waits, late = F.col("status") == "waiting_parser", F.unix_timestamp(now) - F.unix_timestamp("created_at") > seconds
    status = F.when(waits & F.col("_known"), "pending").when(waits & late, "failed").otherwise(F.col("status"))
    attempts = F.col("attempts") + F.when(waits & F.col("_known").isNull() & late, 1).otherwise(0)
    return requests.join(known, "fingerprint", "left").withColumns({"status": status, "attempts": attempts}).select(requests.columns)
