"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line of seconds."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from siltstone.functions.features import with_fingerprint
from siltstone.plans.pipeline import no_rules, process
from siltstone.plans.queries import QUERIES
from siltstone.sources.corpus import raw_logs

HEADLINE = ["q_template_full", "q_fingerprint_hash", "q_fingerprint_topk", "q_status_machine", "q_default_rule", "q_user_stats", "q_page_newest"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        started = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)

    timed("warm_up", lambda: QUERIES["q_fingerprint_hash"](spark, sf))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf))
    timed("fingerprint_corpus", lambda: with_fingerprint(raw_logs(spark, sf)))
    timed("process_corpus", lambda: process(raw_logs(spark, sf), no_rules(spark)).logs)
    n = raw_logs(spark, sf).count()
    total = sum(v for k, v in seconds.items() if k != "warm_up")
    rate = round(n / seconds["fingerprint_corpus"] / int(cpus))
    print(json.dumps({"metric": "log engine headline queries", "value": round(total, 3), "unit": "sec", "queries": seconds, "logs": n, "logs_per_second_per_core": rate, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
