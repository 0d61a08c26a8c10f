"""A deterministic corpus of raw logs made from the events table, twelve shapes by event_id, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_STATUS = "element_at(array('pending','processing','waiting_parser','completed','failed'), cast({id} % 5 as int) + 1)"


def _shapes(iso: str, space: str, bsd: str, web: str, tab: str, nl: str) -> list[str]:
    """One SQL expression a shape; both engines share all but the date formats and escapes."""
    money = "cast(cast(value as decimal(10,2)) as {text})"
    return [
        f"""'{{"timestamp":"' || {iso} || '","user_id":' || user_id || ',"event_type":"' || event_type || '","value":' || {money} || ',"props":' || props || '}}'""",
        f"'time=' || {iso} || ' user=' || user_id || ' type=' || event_type || ' value=' || {money}",
        f"'<' || (8 * (user_id % 24) + 3) || '>' || {bsd} || ' host' || (user_id % 5) || ' app[' || event_id || ']: ' || event_type || ' by user u' || user_id",
        "'CEF:0|Acme|Shop|1.0|' || event_type || '|' || event_type || '|5|src=10.0.0.' || (user_id % 250) || ' cnt=' || event_id",
        f"{iso} || ',10.0.0.' || (user_id % 250) || ',' || event_type || ',' || {money} || ',' || user_id",
        f"{space} || ' ERROR svc-' || event_type || ' server-' || (user_id % 9) || ' failed for user u' || user_id",
        f"'LEEF:1.0|Acme|Shop|2|' || event_type || '|src=10.0.0.' || (user_id % 250) || {tab} || 'sev=5'",
        f"""'<165>1 ' || {iso} || ' host' || (user_id % 5) || ' app 12 ID47 [ex@1 a="' || user_id || '" b="x"] ' || event_type || ' by user u' || user_id""",
        f"{bsd} || ' host' || (user_id % 5) || ' app[' || event_id || ']: ' || event_type || ' took ' || event_id || ' ms'",
        "'<Event id=\"' || event_id || '\"><Type>' || event_type || '</Type><User>' || user_id || '</User></Event>'",
        f"'java.lang.IllegalStateException: ' || event_type || ' ' || event_id || {nl} || {tab} || 'at com.acme.Shop.run(Shop.java:' || (user_id % 90) || ')' || {nl} || 'Caused by: java.io.IOException: reset'",
        f"""'10.0.0.' || (user_id % 250) || ' - u' || user_id || ' [' || {web} || ' +0000] "GET /' || event_type || ' HTTP/1.1" 200 ' || event_id || ' "-" "curl/8.0"'""",
    ]


def _case(shapes: list[str], text: str) -> str:
    return "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN {s.replace('{text}', text)}" for k, s in enumerate(shapes)) + " END"


def spark_expression() -> str:
    f = lambda p: f"date_format(ts, \"{p}\")"
    return _case(_shapes(f("yyyy-MM-dd'T'HH:mm:ss'Z'"), f("yyyy-MM-dd HH:mm:ss"), f("MMM dd HH:mm:ss"), f("dd/MMM/yyyy:HH:mm:ss"), "'\\t'", "'\\n'"), "string")


def duckdb_cte() -> str:
    """CTE `corpus` over the events view."""
    f = lambda p: f"strftime(ts, '{p}')"
    raw = _case(_shapes(f("%Y-%m-%dT%H:%M:%SZ"), f("%Y-%m-%d %H:%M:%S"), f("%b %d %H:%M:%S"), f("%d/%b/%Y:%H:%M:%S"), "chr(9)", "chr(10)"), "varchar")
    status = "(['pending','processing','waiting_parser','completed','failed'])[event_id % 5 + 1]"
    return f"""corpus AS (SELECT event_id AS id, user_id, event_type, ts AS created_at, event_id % 12 AS k, event_id // 5 % 5 AS attempts, {status} AS status, {raw} AS raw_log FROM events)"""


#: Rows of a task whose work on each is heavy (some 300 us).
TASK_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to all cores and to tasks of at most about TASK_ROWS rows, so that a task's work does not grow with the
    table; one whose files have that many splits stays as it is. Parquet files know their rows, so counting reads no data."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def raw_logs(spark: SparkSession, sf_dir: str, heavy: bool = True) -> DataFrame:
    """id, user_id, event_type, created_at, k, attempts, status, raw_log of every event; dealt to all cores where the work
    on each log is heavy enough to be worth an exchange."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spread(events) if heavy else events
    return events.selectExpr("event_id as id", "user_id", "event_type", "ts as created_at", "event_id % 12 as k", "event_id div 5 % 5 as attempts", f"{_STATUS.format(id='event_id')} as status", f"{spark_expression()} as raw_log")
