"""The log engine's queries over the shared tables, each beside the DuckDB SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import normalize as N
from siltstone.functions import patterns as P
from siltstone.functions.features import syslog_parts, with_fingerprint
from siltstone.functions.layouts import extract_timestamp
from siltstone.operators import explore as X
from siltstone.operators import rules as R
from siltstone.operators.parse import TRANSFORMATIONS, with_first_parsed, with_parsed
from siltstone.plans import oracles as O
from siltstone.plans import pipeline as B
from siltstone.sources import logs as L
from siltstone.sources.corpus import raw_logs, spread
from siltstone.sources.scratch import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "timestamp '2024-06-01 00:00:00'"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def marked(spark: SparkSession, sf: str, where: str = "true", columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """Materialised: a filter or join on a fingerprint would otherwise repeat the whole template fold below it. A query's
    own condition on the events' columns goes before the fingerprints, since each of them is made of its row alone."""
    return materialized(with_fingerprint(raw_logs(spark, sf).where(where)).select(*columns), "marked")


def corpus_sql(select: str) -> str:
    return f"WITH {O.duckdb_cte()} {select}"


def marked_sql(select: str) -> str:
    return f"WITH {O.with_marks()} {select}"


def rules_sql(select: str) -> str:
    return f"WITH {O.with_rules()} {select}"


def processed(spark: SparkSession, sf: str) -> B.Processed:
    return B.process(raw_logs(spark, sf), B.no_rules(spark))


# sources -----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '[^\\s]')")
def q_ingest_nonempty(spark, sf):
    return L.nonempty(docs(spark, sf), "text").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query(r"""SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS l FROM documents)
WHERE regexp_matches(l, '[^\s]') GROUP BY doc_id""")
def q_split_lines(spark, sf):
    return L.split_lines(docs(spark, sf), "text", "doc_id").groupBy("doc_id").agg(F.count("*").alias("lines"))


# formats, types, vendors -------------------------------------------------------------------------------------------


@query(marked_sql("SELECT id, format FROM marked"))
def q_detect_format(spark, sf):
    return with_fingerprint(raw_logs(spark, sf)).select("id", "format")


@query(marked_sql("SELECT format, count(*) AS n FROM marked GROUP BY format"))
def q_format_counts(spark, sf):
    return with_fingerprint(raw_logs(spark, sf)).groupBy("format").agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'number' AS id_type, 'string' AS kind_type, 'timestamp' AS ts_type, 'time' AS time_type, 'ipv4' AS ip_type, 'email' AS mail_type FROM events""")
def q_value_type_events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = N.detect_value_type
    ip, mail = F.concat(F.lit("10.0."), F.col("user_id") % 250, F.lit(".1")), F.concat("event_type", F.lit("@example.com"))
    return e.select("event_id", t(F.col("event_id").cast("string")).alias("id_type"), t(F.col("event_type")).alias("kind_type"), t(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts_type"), t(F.date_format("ts", "HH:mm:ss")).alias("time_type"), t(ip).alias("ip_type"), t(mail).alias("mail_type"))


_VENDOR_TEXT = "CASE event_id % 8 WHEN 0 THEN '%ASA-4-106023: x' WHEN 1 THEN '%SYS-5-CONFIG_I: x' WHEN 2 THEN 'devid=FG1 x' WHEN 3 THEN '1,TRAFFIC,drop' WHEN 4 THEN 'RT_FLOW: x' WHEN 5 THEN 'sshd[' || event_id || ']: x' WHEN 6 THEN 'cron[1]: x' ELSE event_type END"


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'cisco/asa' WHEN 1 THEN 'cisco/ios' WHEN 2 THEN 'fortinet/fortigate' WHEN 3 THEN 'palo_alto/pan_os' WHEN 4 THEN 'juniper/junos' WHEN 5 THEN 'linux/sshd' WHEN 6 THEN 'linux/cron' ELSE '/' END AS vendor FROM events")
def q_vendor_product(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", f"{_VENDOR_TEXT} as t")
    v = e.withColumn("v", N.vendor_product(F.col("t")))
    return v.select("event_id", F.concat_ws("/", "v.vendor", "v.product").alias("vendor"))


# templates ---------------------------------------------------------------------------------------------------------


def _step_query(name: str, pattern: str, replacement: str) -> None:
    def run(spark, sf):
        return docs(spark, sf).select("doc_id", F.sha2(N.lone_step(F.col("text"), name), 256).alias("h"))

    QUERIES[f"q_tpl_{name}"] = run
    SQL[f"q_tpl_{name}"] = f"SELECT doc_id, sha256(regexp_replace(text, {O.q(pattern)}, {O.q(replacement)}, 'g')) AS h FROM documents"


for _s in P.STEPS:
    _step_query(*_s)


@query(f"SELECT doc_id, sha256({O.fold('text')}) AS h FROM documents")
def q_template_fold(spark, sf):
    c = F.col("text")
    return docs(spark, sf).select("doc_id", F.sha2(N.steps(c), 256).alias("h"))


@query(corpus_sql(f"SELECT id, {O.template('raw_log')} AS template FROM corpus"))
def q_template_full(spark, sf):
    return raw_logs(spark, sf).select("id", N.normalize_template(F.col("raw_log")).alias("template"))


@query(corpus_sql(f"SELECT id, {O.numbers('raw_log')} AS t FROM corpus"))
def q_remaining_numbers(spark, sf):
    return raw_logs(spark, sf).select("id", N.remaining_numbers(F.col("raw_log")).alias("t"))


@query(corpus_sql(r"SELECT id, trim(regexp_replace('  ' || raw_log || chr(9), '\s+', ' ', 'g')) AS t FROM corpus"))
def q_collapse_ws(spark, sf):
    return raw_logs(spark, sf).select("id", N.collapse_whitespace(F.concat(F.lit("  "), "raw_log", F.lit("\t"))).alias("t"))


@query("SELECT event_id, event_id % 700 BETWEEN 100 AND 599 OR event_id % 700 <= 10 AS status, event_id % 30 <= 24 AS level, event_id % 60 IN (1, 6, 17, 47, 50, 58) AS proto FROM events")
def q_small_enum(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    f = lambda n, key: N.small_enum((F.col("event_id") % n).cast("string"), F.lit(key))
    return e.select("event_id", f(700, "status").alias("status"), f(30, "level").alias("level"), f(60, "proto").alias("proto"))


@query("SELECT event_id, CASE WHEN event_id % 12 <= 10 THEN CAST(event_id % 12 AS VARCHAR) ELSE '<NUMBER>' END AS a, upper(event_type) || '_X' AS b_raw, lower(event_type) AS b, '<IPV4>' AS c, '<TIMESTAMP>' AS d FROM events")
def q_normalize_value(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    f = lambda k, v: N.normalize_value(F.lit(k), v)
    code = (F.col("event_id") % 12).cast("string")
    return e.select("event_id", f("code", code).alias("a"), F.concat(F.upper("event_type"), F.lit("_X")).alias("b_raw"), f("action", F.concat(F.lit('"'), F.upper("event_type"), F.lit('"'))).alias("b"), f("src", F.concat(F.lit("10.0.0."), F.col("user_id") % 250)).alias("c"), f("at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("d"))


# syslog and nested formats -----------------------------------------------------------------------------------------


@query(corpus_sql("SELECT id, CASE k WHEN 2 THEN user_id % 24 WHEN 7 THEN 20 ELSE 0 END AS fac, CASE k WHEN 2 THEN 3 WHEN 7 THEN 5 ELSE 0 END AS sev, CASE k WHEN 7 THEN 1 ELSE 0 END AS ver, 'app' AS app FROM corpus WHERE k IN (2, 7, 8)"))
def q_syslog_headers(spark, sf):
    s = raw_logs(spark, sf).withColumn("s", syslog_parts(F.col("raw_log"))).where("s is not null")
    return s.select("id", F.col("s.fac").cast("long").alias("fac"), F.col("s.sev").cast("int").alias("sev"), F.col("s.ver").cast("int").alias("ver"), "s.app")


def _shape_query(name: str, shapes: str) -> None:
    QUERIES[name] = lambda spark, sf: marked(spark, sf, f"k in ({shapes})").select("id", "canonical")
    SQL[name] = marked_sql(f"SELECT id, canonical FROM marked WHERE k IN ({shapes})")


for _name, _k in [("q_json_schema", "0"), ("q_kv_signature", "1"), ("q_syslog_3164", "2"), ("q_cef_ext", "3"), ("q_csv_types", "4"), ("q_text_template", "5"), ("q_leef_ext", "6"), ("q_syslog_5424", "7"), ("q_syslog_bsd", "8"), ("q_xml_paths", "9"), ("q_multiline_sig", "10"), ("q_web_access", "11")]:
    _shape_query(_name, _k)


@query()
def q_xml_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.col("html").alias("raw_log"))
    return with_fingerprint(p).select("page_id", "format", "fingerprint")


# fingerprints ------------------------------------------------------------------------------------------------------


@query(marked_sql("SELECT id, fingerprint FROM marked"))
def q_fingerprint_hash(spark, sf):
    return with_fingerprint(raw_logs(spark, sf)).select("id", "fingerprint")


@query(marked_sql("SELECT fingerprint, count(*) AS n FROM marked GROUP BY fingerprint ORDER BY n DESC, fingerprint LIMIT 10"))
def q_fingerprint_topk(spark, sf):
    return with_fingerprint(raw_logs(spark, sf)).groupBy("fingerprint").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "fingerprint").limit(10)


# rules and parsing -------------------------------------------------------------------------------------------------


@query(corpus_sql(f"SELECT id, ({O.default_rule('raw_log')}).name AS name, ({O.default_rule('raw_log')}).pattern AS pattern FROM corpus"))
def q_default_rule(spark, sf):
    return raw_logs(spark, sf).withColumn("r", R.default_rule(F.col("raw_log"))).select("id", "r.name", "r.pattern")


_FIVE = P.DEFAULT_RULES[0][1]


_FIELDS = ("timestamp", "severity", "service", "host", "message")
_STRUCTURED = {
    "timestamp": r"strftime(strptime(regexp_extract(raw_log, '^(\S+ \S+) ', 1), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%SZ')",
    "severity": "'ERROR'",
    "service": "'svc-' || event_type",
    "host": "'server-' || (user_id % 9)",
    "message": "'failed for user u' || user_id",
}


@query(corpus_sql("SELECT id, " + ", ".join(f"CASE WHEN contains(raw_log, chr(10)) THEN NULL WHEN regexp_matches(raw_log, {O.q(_FIVE)}) THEN {v} ELSE {'raw_log' if c == 'message' else O.q('')} END AS {c}" for c, v in _STRUCTURED.items()) + " FROM corpus"))
def q_parse_rules(spark, sf):
    p = with_parsed(raw_logs(spark, sf).withColumn("r", R.default_rule(F.col("raw_log"))).select("id", "raw_log", "r.*"))
    return p.select("id", *(f"normalized.{c}" for c in _FIELDS))


@query(corpus_sql("SELECT id, CASE WHEN k = 2 THEN 'u' || user_id END AS actor, CASE WHEN k = 2 THEN event_type END AS message, CASE WHEN k = 2 THEN CAST(id AS VARCHAR) END AS pid FROM corpus"))
def q_parse_metadata(spark, sf):
    rule = r"^<\d+>.*app\[(?P<p_id>\d+)\]: (?<what>\w+) by user (?P<who>\S+)$"
    mapping = F.create_map(*[F.lit(x) for x in ("p_id", "metadata.pid", "who", "actor", "what", "message")])
    p = with_parsed(raw_logs(spark, sf).select("id", "raw_log", F.lit(rule).alias("pattern"), mapping.alias("mapping"), F.lit(None).cast(TRANSFORMATIONS).alias("transformations")))
    return p.select("id", F.col("normalized.metadata")["actor"].alias("actor"), "normalized.message", F.col("normalized.metadata")["pid"].alias("pid"))


def unmapped(df: DataFrame, pattern: str, raw: str = "raw_log", steps=None) -> DataFrame:
    """df parsed by one pattern without a mapping."""
    steps = F.lit(None) if steps is None else steps
    return with_parsed(df.withColumns({"pattern": F.lit(pattern), "mapping": F.lit(None).cast("map<string,string>"), "transformations": steps.cast(TRANSFORMATIONS)}), raw)


@query(corpus_sql("SELECT k, CASE WHEN contains(raw_log, 'ERROR') THEN 'partial match' ELSE 'no match' END AS error, count(*) AS n FROM corpus GROUP BY 1, 2"))
def q_parse_errors(spark, sf):
    return unmapped(raw_logs(spark, sf), r"(?P<severity>ERROR)").groupBy("k", "error").agg(F.count("*").alias("n"))


@query(corpus_sql(r"SELECT id, CASE WHEN k = 8 THEN regexp_extract(raw_log, '(host\d+) app', 1) END AS host, CASE WHEN k = 8 THEN event_type END AS what, CASE WHEN k = 8 THEN regexp_extract(raw_log, 'took (\d+)', 1) END AS ms FROM corpus"))
def q_parse_nomap(spark, sf):
    p = unmapped(raw_logs(spark, sf), r"^\w+ \d+ [\d:]+ (?P<host>\w+) app\[\d+\]: (?P<what>\w+) took (?P<ms>\d+) ms$")
    return p.select("id", "normalized.host", F.col("normalized.metadata")["what"].alias("what"), F.col("normalized.metadata")["ms"].alias("ms"))


_TRANSFORMS = {
    "upper": ("event_type", "upper(event_type)"),
    "lower": ("concat(event_type, 'X')", "lower(event_type || 'X')"),
    "trim": ("concat('  ', event_type, '\t')", "event_type"),
    "int": ("concat('00', event_id)", "CAST(event_id AS VARCHAR)"),
    "epoch_s": ("cast(1700000000 + event_id as string)", "strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"),
    "epoch_ms": ("cast(1700000000000 + event_id as string)", "strftime(make_timestamp(((1700000000000 + event_id) // 1000) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"),
    "float": ("concat('0', event_id, '.50')", "event_id || '.5'"),
    "datetime": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"),
}


def _transform_query(kind: str, spark_sql: str, duck: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        events = spread(spark.read.parquet(f"{sf}/events.parquet")).select("event_id", F.expr(spark_sql).alias("raw"))
        layout = "2006-01-02 15:04:05" if kind == "datetime" else ""
        step = F.create_map(F.lit("v"), F.struct(F.lit(kind).alias("type"), F.lit(layout).alias("format")))
        return unmapped(events, r"(?P<v>[\s\S]*)", "raw", step).select("event_id", F.col("normalized.metadata")["v"].alias("v"))

    QUERIES[f"q_transform_{kind}"] = run
    SQL[f"q_transform_{kind}"] = f"SELECT event_id, {duck} AS v FROM events"


for _kind, (_a, _b) in _TRANSFORMS.items():
    _transform_query(_kind, _a, _b)


@query("SELECT event_id, substr(sha256('^(' || event_type || event_id || ')$'), 1, 16) AS key FROM events")
def q_manual_key(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", R.manual_key(F.concat(F.lit("^("), "event_type", "event_id", F.lit(")$"))).alias("key"))


# branches that the corpus of logs does not reach -------------------------------------------------------------------


def crafted(spark: SparkSession, sf: str, text) -> DataFrame:
    """event_id, event_type, ts and raw_log of every event."""
    return spread(spark.read.parquet(f"{sf}/events.parquet")).select("event_id", "event_type", "ts", text.alias("raw_log"))


def _canonical_query(name: str, parts: list[str], expected: str) -> None:
    """Canonical form of a text made of literals and (marked by $) expressions over events."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        text = F.concat(*(F.expr(p[1:]).cast("string") if p[0] == "$" else F.lit(p) for p in parts))
        return with_fingerprint(crafted(spark, sf, text)).select("event_id", "canonical")

    QUERIES[name] = run
    raw = " || ".join(f"CAST({p[1:]} AS VARCHAR)" if p[0] == "$" else O.q(p) for p in parts)
    SQL[name] = f"SELECT event_id, {expected} AS canonical FROM (SELECT *, {raw} AS raw_log FROM events)"


_canonical_query("q_syslog_pri", ["<", "$event_id % 300", ">free text here"], f"CASE WHEN event_id % 300 <= 191 THEN 'fp-v1:format=syslog|ver=0|fac=' || (event_id % 300 // 8) || '|sev=' || (event_id % 300 % 8) || '|app=|msg_id=|template=free text here' ELSE 'fp-v1:format=plain_text|template=' || {O.template('raw_log')} END")
_canonical_query("q_syslog_sd", ["<", "$event_id % 192", '>1 2024-01-02T03:04:05Z h app 1 ID [b@1 z="', "$event_id", '" y="1"][a@2 x="q"] done'], "'fp-v1:format=syslog|ver=1|fac=' || (event_id % 192 // 8) || '|sev=' || (event_id % 192 % 8) || '|app=app|msg_id=ID|sd=a@2.x,b@1.y,b@1.z|template=done'")
_canonical_query("q_cef_header", ["CEF:0|Ac\\|me|Sh\\\\op|1.0|", "$event_type", "|Na\\|me|", "$event_id % 11", "|cnt=", "$event_id"], "'fp-v1:format=cef|vendor=ac|me|product=sh\\op|ver=0|dev_vendor=Ac|me|dev_product=Sh\\op|dev_ver=1.0|class_id=' || event_type || '|sev=' || (event_id % 11) || '|ext=cnt:number'")
_canonical_query("q_csv_header", ["$event_type", ",Level,Host Name,", "$CASE WHEN event_id % 2 = 0 THEN 'Count' ELSE '7' END"], "'fp-v1:format=csv|delim=,|cols=4|header=' || CASE WHEN event_id % 2 = 0 THEN 'true|headers=' || lower(event_type) || ',level,host name,count|types=string,string,string,string' ELSE 'false|types=string,string,string,number' END")
_canonical_query("q_leef_delimiter", ["LEEF:2.0|Acme|Shop|2|", "$event_type", "|^|src=10.0.0.1^cnt=", "$event_id"], "'fp-v1:format=leef|vendor=acme|product=shop|ver=2.0|vendor=Acme|product=Shop|prod_ver=2|event_id=' || event_type || '|delim=^|ext=cnt:number,src:ipv4'")
_canonical_query("q_json_array", ['[{"a":', "$event_id", '},{"b":[],"a":"x"},{"c":[null,1],"d":true}]'], "'fp-v1:format=json|schema=array[object{a:number,b:array[unknown],c:array[null],d:bool}]'")


@query(f"SELECT doc_id, len(t) AS n, sha256(array_to_string(t, chr(10))) AS h FROM (SELECT doc_id, list_filter(list_transform(string_split({O.template('text')}, ' '), lambda w: trim(w, '()[]{{}}:,\"' || chr(39))), lambda w: w <> '') AS t FROM documents)")
def q_text_tokens(spark, sf):
    """Whole texts: the fold without the cut that templates of logs get."""
    c = F.col("text")
    tokens = N.structural_tokens(N.remaining_numbers(N.steps(c)))
    return docs(spark, sf).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", "\n"), 256).alias("h"))


#: For each layout of a lone timestamp: Spark's pattern of the text (|d| is the day with a leading blank), the shift to UTC, whether it has a year.
_LAYOUTS = [
    ("yyyy-MM-dd'T'HH:mm:ss'Z'", "0 minute", True), ("yyyy-MM-dd'T'HH:mm:ss'.123+02:00'", "-120 minute", True), ("yyyy-MM-dd'T'HH:mm:ss'+0200'", "-120 minute", True),
    ("yyyy-MM-dd HH:mm:ss", "0 minute", True), ("yyyy-MM-dd HH:mm:ss'.250'", "0 minute", True), ("dd/MMM/yyyy:HH:mm:ss' -0330'", "210 minute", True), ("MMM |d| HH:mm:ss", "0 minute", False),
    ("MMM dd HH:mm:ss", "0 minute", False), ("E MMM |d| HH:mm:ss yyyy", "0 minute", True), ("E MMM |d| HH:mm:ss' UTC 'yyyy", "0 minute", True), ("E MMM dd HH:mm:ss' -0700 'yyyy", "420 minute", True),
    ("yyyy/MM/dd HH:mm:ss", None, True),
]
_MOMENTS = " ".join(f"WHEN {i} THEN " + ("NULL" if by is None else f"strftime(ts + INTERVAL '{by}', '{'%Y' if year else '0000'}-%m-%dT%H:%M:%SZ')") for i, (_, by, year) in enumerate(_LAYOUTS))


@query(f"SELECT event_id, CASE event_id % {len(_LAYOUTS)} {_MOMENTS} END AS moment FROM events")
def q_layout_timestamp(spark, sf):
    kind = F.col("event_id") % len(_LAYOUTS)
    shown = lambda p: F.lpad(F.dayofmonth("ts").cast("string"), 2, " ") if p == "d" else F.date_format("ts", p)
    text = F.coalesce(*(F.when(kind == i, F.concat(*map(shown, p.split("|")))) for i, (p, _, _) in enumerate(_LAYOUTS)))
    return crafted(spark, sf, text).select("event_id", extract_timestamp("raw_log").alias("moment"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(['Event', 'Type', 'User']) AS tag FROM events WHERE event_id % 12 = 9) GROUP BY tag")
def q_xml_tags(spark, sf):
    return X.tag_counts(raw_logs(spark, sf))


# processing --------------------------------------------------------------------------------------------------------


@query(rules_sql("SELECT id, result AS status, attempts + CASE WHEN result = 'failed' THEN 1 ELSE 0 END AS attempts FROM done UNION ALL SELECT id, status, attempts FROM corpus WHERE NOT (status = 'pending' AND attempts < 3)"))
def q_status_machine(spark, sf):
    return processed(spark, sf).requests.select("id", "status", F.col("attempts").cast("long").alias("attempts"))


@query(rules_sql("SELECT hash, rule.name AS name, rule.pattern AS pattern FROM rules"))
def q_single_flight(spark, sf):
    taken = marked(spark, sf, B.ELIGIBLE)
    return R.synthesize(B.representatives(taken)).select("hash", "name", "pattern")


@query(rules_sql("SELECT hash, waiting FROM rules"))
def q_waiters(spark, sf):
    return marked(spark, sf, B.ELIGIBLE).groupBy(F.col("fingerprint").alias("hash")).agg(F.count_distinct("id").alias("waiting"))


@query(rules_sql("SELECT m.id, r.rule.name AS rule FROM marked m JOIN rules r ON m.fingerprint = r.hash"))
def q_parser_lookup(spark, sf):
    m = marked(spark, sf)
    rules = R.synthesize(B.representatives(B.eligible(m))).select("hash", F.col("name").alias("rule"))
    return m.join(rules, F.col("fingerprint") == F.col("hash")).select("id", "rule")


@query(rules_sql("SELECT id FROM marked WHERE fingerprint NOT IN (SELECT hash FROM rules WHERE format = 'cef')"))
def q_parser_miss(spark, sf):
    m = marked(spark, sf)
    rules = R.synthesize(B.representatives(B.eligible(m))).where("format = 'cef'")
    return B.unmatched(m, rules).select("id")


@query(rules_sql("""SELECT c.id, count(d.id) AS logs FROM corpus c LEFT JOIN done d ON c.id = d.id AND d.result = 'completed' WHERE c.status = 'pending' GROUP BY c.id"""))
def q_request_logs(spark, sf):
    done = processed(spark, sf)
    pending = raw_logs(spark, sf).where("status = 'pending'")
    return X.with_logs(pending, done.logs).select("id", F.size("logs").cast("long").alias("logs"))


@query(rules_sql("SELECT id, user_id, raw_log, fingerprint AS hash FROM done WHERE result = 'completed'"))
def q_request_detail(spark, sf):
    return processed(spark, sf).logs.select("id", "user_id", "raw_log", "hash")


@query(marked_sql("SELECT id FROM marked WHERE fingerprint IN (SELECT fingerprint FROM marked WHERE k = 3 AND event_type = 'error')"))
def q_hash_semi(spark, sf):
    m = marked(spark, sf)
    return m.join(m.where("k = 3 and event_type = 'error'").select(F.col("fingerprint").alias("h")), F.col("fingerprint") == F.col("h"), "left_semi").select("id")


@query("SELECT DISTINCT c_name AS email FROM customer WHERE c_nationkey <> 5")
def q_user_new(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("email", F.col("c_name"))
    return L.new_users(c.where("c_nationkey = 5").select("email"), c.select("email")).select("email")


@query(rules_sql("SELECT hash, 1 + count(d.id) AS processed, max(d.created_at) AS last_used FROM rules r LEFT JOIN done d ON r.hash = d.fingerprint AND d.result = 'completed' GROUP BY hash"))
def q_parser_usage(spark, sf):
    m = marked(spark, sf)
    rules = R.synthesize(B.representatives(B.eligible(m))).withColumns({"logs_processed": F.lit(1).cast("long"), "last_used": F.lit(None).cast("timestamp_ntz")})
    done = processed(spark, sf).logs.select(F.col("hash").alias("fingerprint"), F.col("request_created_at").alias("at"))
    return R.count_usage(rules, done).select("hash", F.col("logs_processed").alias("processed"), "last_used")


@query(rules_sql("SELECT hash, CASE WHEN format = 'cef' THEN 'CEF rule' WHEN rule.name <> '' THEN rule.name WHEN format = 'leef' THEN 'shopParser' ELSE format || 'Parser' END AS name, CASE WHEN format = 'cef' THEN 'new' ELSE rule.pattern END AS pattern, CASE WHEN format = 'cef' THEN 7 ELSE 0 END AS processed FROM rules"))
def q_parser_upsert(spark, sf):
    base = R.upsert(B.no_rules(spark), R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))
    old = base.withColumn("logs_processed", F.when(F.col("format") == "cef", 7).otherwise(0).cast("long"))
    new = old.where("format = 'cef'").withColumns({"name": F.lit("CEF rule"), "pattern": F.lit("new"), "vendor": F.lit(""), "logs_processed": F.lit(99).cast("long")})
    return R.upsert(old, new).select("hash", "name", "pattern", F.col("logs_processed").cast("int").alias("processed"))


# exploration -------------------------------------------------------------------------------------------------------


@query(corpus_sql("SELECT user_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing, count(*) FILTER (status = 'waiting_parser') AS waiting_parser, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, max(created_at) AS last_activity FROM corpus GROUP BY user_id"))
def q_user_stats(spark, sf):
    return X.user_stats(raw_logs(spark, sf, heavy=False))


@query(rules_sql("SELECT count(*) AS rules, count(*) AS active, 0::BIGINT AS processed FROM rules"))
def q_parser_metrics(spark, sf):
    return X.rule_metrics(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))


@query(rules_sql("SELECT DISTINCT format FROM rules"))
def q_format_facet(spark, sf):
    return X.formats(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))


@query(corpus_sql("SELECT id, created_at FROM corpus ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50"))
def q_page_newest(spark, sf):
    return X.newest_page(raw_logs(spark, sf, heavy=False), 3, 0).select("id", "created_at")


@query(corpus_sql("SELECT id FROM corpus WHERE status = 'pending' AND attempts < 3"))
def q_pending_ids(spark, sf):
    return B.eligible(raw_logs(spark, sf, heavy=False)).select("id")


@query(corpus_sql("SELECT id FROM corpus WHERE contains(lower(raw_log), 'purchase') OR contains(CAST(id AS VARCHAR), 'purchase') OR contains(status, 'purchase')"))
def q_search_logs(spark, sf):
    return X.search_logs(raw_logs(spark, sf), "PURCHASE").select("id")


@query(rules_sql("SELECT hash FROM rules WHERE contains(lower(rule.name || ' ' || format || ' ' || rule.pattern), 'severity')"))
def q_search_parsers(spark, sf):
    return X.search_rules(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))), "SEVERITY", "active").select("hash")


@query(marked_sql("SELECT format AS label, fingerprint AS hash, count(*) AS logs_processed FROM marked GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 6"))
def q_top6(spark, sf):
    used = marked(spark, sf).groupBy(F.col("fingerprint").alias("hash"), F.col("format").alias("name")).agg(F.count("*").alias("logs_processed"))
    return X.top_rules(used.withColumn("format", F.col("name"))).select("label", "hash", "logs_processed")


@query(corpus_sql("SELECT id, coalesce(nullif(status, ''), '—') AS status, raw_log FROM corpus ORDER BY created_at DESC, id DESC LIMIT 5"))
def q_recent5(spark, sf):
    return X.newest_page(raw_logs(spark, sf, heavy=False), 1, 5).select("id", F.coalesce(F.nullif("status", F.lit("")), F.lit("—")).alias("status"), "raw_log")


def _made_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Logs of two requests in three, some twice, with empty and missing fields."""
    r = raw_logs(spark, sf).where("id % 3 > 0").selectExpr("id", "explode(sequence(1, cast(id % 2 + 1 as int))) as i", "event_type", "user_id")
    return r.selectExpr(
        "id", "concat('h', i) as hash",
        "named_struct('timestamp', '', 'severity', if(id % 4 = 0, '', concat('L', i)), 'service', if(id % 5 = 0, cast(null as string), event_type), 'message', if(id % 7 = 0, '', concat('say \"', id, '\"')), 'metadata', if(id % 4 = 1, map('u', cast(user_id as string), 'a', 'b'), cast(map() as map<string,string>))) as normalized",
    )


@query(corpus_sql("SELECT id, CASE WHEN id % 3 > 0 AND id % 4 <> 0 THEN 'L1' ELSE '—' END AS level, CASE WHEN id % 3 > 0 AND id % 5 <> 0 THEN event_type ELSE '—' END AS service, CASE WHEN id % 3 > 0 AND id % 7 <> 0 THEN 'say \"' || id || '\"' ELSE raw_log END AS message FROM corpus"))
def q_first_log(spark, sf):
    return X.first_logs(raw_logs(spark, sf), _made_logs(spark, sf)).select("id", "level", "service", "message")


@query(corpus_sql("""SELECT id, '{' || chr(10) || '  "severity": "' || CASE WHEN id % 4 = 0 THEN '' ELSE 'L1' END || '",' || chr(10) || CASE WHEN id % 5 = 0 THEN '' ELSE '  "service": "' || event_type || '",' || chr(10) END
|| '  "message": "' || CASE WHEN id % 7 = 0 THEN '' ELSE 'say \\"' || id || '\\"' END || '"' || CASE WHEN id % 4 = 1 THEN ',' || chr(10) || '  "metadata": {' || chr(10) || '    "a": "b",' || chr(10) || '    "u": "' || user_id || '"' || chr(10) || '  }' ELSE '' END || chr(10) || '}' AS shown FROM corpus WHERE id % 3 > 0"""))
def q_pretty_log(spark, sf):
    first = _made_logs(spark, sf).groupBy("id").agg(F.min_by("normalized", "hash").alias("normalized"))
    return first.select("id", X.pretty(F.col("normalized"), ["severity", "service", "message"]).alias("shown"))


@query(rules_sql("SELECT hash AS value, coalesce(nullif(rule.name, ''), hash) AS label FROM rules UNION ALL SELECT 'all', 'All rules'"))
def q_rule_options(spark, sf):
    return X.rule_options(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))


@query(corpus_sql("SELECT id, CASE WHEN status <> 'waiting_parser' THEN status WHEN k < 6 THEN 'pending' WHEN epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(date_trunc('second', created_at)) > 86400 THEN 'failed' ELSE status END AS status FROM corpus"))
def q_waiting_again(spark, sf):
    requests = raw_logs(spark, sf).withColumn("fingerprint", F.col("k").cast("string"))
    rules = spark.range(6).selectExpr("cast(id as string) as hash", "'x' as pattern", "'Active' as status")
    return B.waiting_again(requests, rules, F.expr(NOW).cast("timestamp"), 86400).select("id", "status")


@query(corpus_sql("SELECT id, CASE WHEN length(trim(split_part(raw_log, chr(10), 1))) > 40 THEN left(trim(split_part(raw_log, chr(10), 1)), 40) || '…' ELSE trim(split_part(raw_log, chr(10), 1)) END AS preview FROM corpus"))
def q_preview(spark, sf):
    return raw_logs(spark, sf).select("id", X.preview(F.col("raw_log"), 40).alias("preview"))


_S = f"(epoch({NOW}) - epoch(date_trunc('second', created_at)))::BIGINT"


@query(corpus_sql(f"SELECT id, CASE WHEN {_S} < 60 THEN 'Just now' WHEN {_S} < 3600 THEN ({_S} // 60) || ' min ago' WHEN {_S} < 86400 THEN ({_S} // 3600) || ' hr ago' WHEN {_S} < 604800 THEN ({_S} // 86400) || ' days ago' ELSE strftime(created_at, '%Y-%m-%d') END AS ago FROM corpus"))
def q_time_ago(spark, sf):
    return raw_logs(spark, sf).select("id", X.time_ago(F.col("created_at"), F.expr(NOW)).alias("ago"))


@query(corpus_sql("SELECT user_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS n FROM corpus) WHERE n = 1"))
def q_newest_per_user(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return raw_logs(spark, sf, heavy=False).withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "id", "created_at")


def streamed(spark: SparkSession, sf: str) -> str:
    """The corpus as files through the streaming queries until all are taken and none waits; gives the folder of their tables."""
    from siltstone.sources.scratch import folder
    from siltstone.streaming import stream

    base = folder(spark, "stream")
    rows = raw_logs(spark, sf).selectExpr("id", "user_id", "raw_log", "status", "cast(attempts as int) as attempts", "created_at")
    files = max(3, rows.rdd.getNumPartitions())  # a file a task of logs, so that none grows with the table
    rows.repartition(files, "id").write.parquet(f"{base}/in")
    stream.run(stream.source(spark, f"{base}/in", -(-files * 2 // 3)), f"{base}/out", f"{base}/state")
    return f"{base}/out"


@query(rules_sql("SELECT id, fingerprint AS hash FROM done WHERE result = 'completed'"))
def q_stream_pipeline(spark, sf):
    from siltstone.streaming import stream

    return stream.latest(spark, streamed(spark, sf), "logs").select("id", "hash")


@query(rules_sql("SELECT id, result AS status, attempts + CASE WHEN result = 'failed' THEN 1 ELSE 0 END AS attempts FROM done UNION ALL SELECT id, status, attempts FROM corpus WHERE NOT (status = 'pending' AND attempts < 3)"))
def q_stream_requests(spark, sf):
    from siltstone.streaming import stream

    return stream.latest(spark, streamed(spark, sf), "requests").select("id", "status", F.col("attempts").cast("long").alias("attempts"))


@query(rules_sql("SELECT hash, rule.name AS name, count(d.id) AS processed FROM rules r LEFT JOIN done d ON r.hash = d.fingerprint AND d.result = 'completed' GROUP BY ALL"))
def q_stream_usage(spark, sf):
    from siltstone.streaming import stream

    made = stream.rules_with_usage(spark, streamed(spark, sf))
    given = F.when(F.col("name").rlike("^[a-z_]+Parser$"), "").otherwise(F.col("name"))  # the default rule has no name of its own
    return made.select("hash", given.alias("name"), F.col("logs_processed").alias("processed"))


# feature records ---------------------------------------------------------------------------------------------------


#: By shape of the corpus, written out by hand: what the record of each log says.
_KEYS = {0: "event_type,props,timestamp,user_id,value", 1: "time,type,user,value", 3: "cnt,src", 6: "sev,src", 7: "ex@1.a,ex@1.b", 9: "Event,Event/Type,Event/User"}
_TYPES = {0: "string,object,timestamp,number,number", 1: "timestamp,string,number,number", 3: "number,ipv4", 6: "number,ipv4"}
_COUNTS = [5, 4, 4, 9, 5, 8, 7, 7, 3, 3, 3, 11]
_TOKENS = {
    2: "'syslog rfc3164 app'",
    5: "'<TIMESTAMP> ERROR svc-' || event_type || ' <DYNAMIC_ID> failed for user <USER>'",
    7: "'syslog rfc5424 app ID47'",
    8: "'syslog bsd app'",
    11: "'<IPV4> - <USER> <TIMESTAMP> GET /' || event_type || ' HTTP/1.1 <NUMBER> <NUMBER> - <USER_AGENT>'",
}


def by_shape(values: dict[int, str], other: str = "''") -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def text_by_shape(values: dict[int, str]) -> str:
    return by_shape({k: O.q(v) for k, v in values.items()})


def _feature_query(name: str, fields: dict[str, tuple[str, str]]) -> None:
    """Columns of the record of every log: by name, the Spark and the DuckDB expression."""

    parts = sorted(set(re.findall(r"\bfeatures\.(\w+)", " ".join(expr for expr, _ in fields.values()))))

    def run(spark: SparkSession, sf: str) -> DataFrame:
        made = with_fingerprint(raw_logs(spark, sf), record=True)
        # each part is named once, so that Spark makes no other: a record named more often is made whole
        made = made.select("id", F.struct(*(F.col(f"features.{p}").alias(p) for p in parts)).alias("features"))
        return made.selectExpr("id", *(f"{expr} as {n}" for n, (expr, _) in fields.items()))

    QUERIES[name] = run
    SQL[name] = corpus_sql("SELECT id, " + ", ".join(f"{expr} AS {n}" for n, (_, expr) in fields.items()) + " FROM corpus")


def _own(k: int, expr: str) -> str:
    return f"CASE WHEN k = {k} THEN {expr} END"


_ext = lambda form: f"array_join(transform(features.{form}.extension_fields, x -> concat(x.key, ':', x.type)), ',')"
_feature_query(
    "q_features_record",
    {
        "version": ("features.version", "'fp-v1'"),
        "delimiter": ("features.delimiter", text_by_shape({1: " ", 3: "|", 4: ",", 6: "|"})),
        "field_count": ("features.field_count", by_shape(dict(enumerate(map(str, _COUNTS))))),
        "keys": ("array_join(features.keys, ',')", text_by_shape(_KEYS)),
        "types": ("array_join(transform(features.field_signatures, x -> x.type), ',')", text_by_shape(_TYPES)),
        "tokens": ("array_join(features.structural_tokens, ' ')", by_shape(_TOKENS)),
        "json_schema": ("features.json_schema", _own(0, "'object{event_type:string,props:object{k:number},timestamp:timestamp,user_id:number,value:number}'")),
        "hierarchy": ("features.xml_hierarchy", _own(9, "'Event[id];Event/Type;Event/User;'")),
    },
)
_feature_query(
    "q_features_syslog",
    {
        "fac": ("features.syslog.facility", by_shape({2: "user_id % 24", 7: "20", 8: "0"}, "NULL")),
        "sev": ("features.syslog.severity", by_shape({2: "3", 7: "5", 8: "0"}, "NULL")),
        "ver": ("features.syslog.version", by_shape({2: "0", 7: "1", 8: "0"}, "NULL")),
        "app": ("features.syslog.app_name", by_shape({2: "'app'", 7: "'app'", 8: "'app'"}, "NULL")),
        "msg_id": ("features.syslog.msg_id", by_shape({2: "''", 7: "'ID47'", 8: "''"}, "NULL")),
        "sd": ("array_join(features.syslog.structured_keys, ',')", by_shape({2: "''", 7: "'ex@1.a,ex@1.b'", 8: "''"}, "NULL")),
        "marks": ("concat(features.syslog.has_timestamp, features.syslog.has_hostname, features.syslog.has_pid)", by_shape({k: "'truetruetrue'" for k in (2, 7, 8)}, "NULL")),
    },
)
_feature_query(
    "q_features_cef",
    {
        "ver": ("features.cef.version", _own(3, "0")),
        "device": ("concat_ws('/', features.cef.device_vendor, features.cef.device_product, features.cef.device_version)", by_shape({3: "'Acme/Shop/1.0'"})),
        "class_id": ("features.cef.device_event_class_id", _own(3, "event_type")),
        "severity": ("features.cef.severity", _own(3, "'5'")),
        "ext": (_ext("cef"), _own(3, "'cnt:number,src:ipv4'")),
    },
)
_feature_query(
    "q_features_leef",
    {
        "device": ("concat_ws('/', features.leef.version, features.leef.vendor, features.leef.product, features.leef.product_version)", by_shape({6: "'1.0/Acme/Shop/2'"})),
        "event": ("features.leef.event_id", _own(6, "event_type")),
        "delim": ("features.leef.delimiter", _own(6, "chr(9)")),
        "ext": (_ext("leef"), _own(6, "'sev:number,src:ipv4'")),
    },
)
_feature_query(
    "q_features_csv",
    {
        "delim": ("features.csv.delimiter", _own(4, "','")),
        "cols": ("features.csv.column_count", _own(4, "5")),
        "header": ("features.csv.has_header", _own(4, "false")),
        "types": ("array_join(features.csv.column_types, ',')", _own(4, "'timestamp,ipv4,string,number,number'")),
    },
)
_feature_query(
    "q_features_kv",
    {
        "style": ("concat(features.kv.separator, features.kv.delimiter, features.kv.quoting_style)", _own(1, "'= '")),
        "repeated": ("features.kv.has_duplicates", _own(1, "false")),
        "fields": ("array_join(transform(features.kv.fields, x -> concat(x.key, ':', x.type)), ',')", _own(1, "'time:timestamp,type:string,user:number,value:number'")),
    },
)
_feature_query(
    "q_features_multiline",
    {
        "lines": ("features.multiline.line_count", _own(10, "3")),
        "stack": ("features.multiline.is_stack_trace", _own(10, "true")),
        "prefix": ("features.multiline.prefix_type", _own(10, "'java_stack'")),
        "signs": ("array_join(features.multiline.line_signatures, '/')", _own(10, "'java.lang.IllegalStateException: ' || event_type || ' <NUMBER>/at com.acme.Shop.run/Caused by: java.io.IOException: reset'")),
    },
)


_RULE_KEYS = f"CASE WHEN k IN ({', '.join(map(str, _KEYS))}) THEN {text_by_shape(_KEYS)} WHEN r.rule.name <> '' THEN 'host,message,service,severity,timestamp' ELSE 'message' END"


@query(rules_sql(f"SELECT hash, {text_by_shape({1: ' ', 3: '|', 4: ',', 6: '|'})} AS delimiter, {_RULE_KEYS} AS fields, {text_by_shape(_TYPES)} AS types, sample AS sample_log FROM rules r JOIN (SELECT fingerprint, arg_min(k, id) AS k, arg_min(raw_log, id) AS sample FROM taken GROUP BY 1) t ON r.hash = t.fingerprint"))
def q_parser_fields(spark, sf):
    made = R.upsert(B.no_rules(spark), R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))
    return made.select("hash", "delimiter", F.array_join("extracted_fields", ",").alias("fields"), F.array_join(F.transform("field_signatures", lambda x: x["type"]), ",").alias("types"), "sample_log")


@query(rules_sql(f"SELECT hash, replace({_RULE_KEYS}, ',', ', ') AS fields FROM rules r JOIN (SELECT fingerprint, arg_min(k, id) AS k FROM taken GROUP BY 1) t ON r.hash = t.fingerprint"))
def q_field_chips(spark, sf):
    return X.field_chips(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))))


@query(rules_sql("SELECT hash FROM rules r JOIN (SELECT fingerprint, arg_min(raw_log, id) AS sample FROM taken GROUP BY 1) t ON r.hash = t.fingerprint WHERE contains(lower(sample), 'acme')"))
def q_search_samples(spark, sf):
    """Rules found by their sample log."""
    return X.search_rules(R.synthesize(B.representatives(marked(spark, sf, B.ELIGIBLE))), "ACME").select("hash")


@query(marked_sql("SELECT id, fingerprint AS hash, raw_log, " + by_shape(dict(enumerate(map(str, _COUNTS)))) + " AS field_count FROM marked WHERE k NOT IN (3, 4)"))
def q_messages(spark, sf):
    """Queue messages of all logs, those of one shape broken off and those of another without a hash: both are dropped."""
    made = with_fingerprint(raw_logs(spark, sf), record=True)
    body = L.message_body(F.when(F.col("k") != 4, F.col("fingerprint")).otherwise(""), F.col("raw_log"), F.col("features"))
    sent = made.select("id", F.when(F.col("k") == 3, F.left(body, F.lit(40))).otherwise(body).alias("body"))
    return L.messages(materialized(sent, "messages")).select("id", "hash", "raw_log", F.col("features.field_count").alias("field_count"))


@query(corpus_sql("SELECT id, raw_log, 'pending' AS status, 0 AS attempts FROM corpus UNION ALL SELECT -1 - doc_id, text, 'pending', 0 FROM documents"))
def q_append_requests(spark, sf):
    """Two sources appended to one request table."""
    from siltstone.sources.scratch import folder

    path = folder(spark, "requests")
    L.append_requests(raw_logs(spark, sf).select("id", "raw_log"), path)
    L.append_requests(docs(spark, sf).select((-1 - F.col("doc_id")).alias("id"), F.col("text").alias("raw_log")), path)
    return spark.read.parquet(path)


@query(marked_sql("SELECT id, CASE WHEN regexp_full_match(raw_log, '.*u[0-9]*[02468]') THEN 1 WHEN NOT contains(raw_log, chr(10)) THEN 2 END AS candidate, CASE WHEN contains(raw_log, chr(10)) THEN 'no match' END AS error FROM marked"))
def q_collisions(spark, sf):
    """Two rules of every hash: each log takes the first that fits it whole."""
    m = marked(spark, sf, columns=("id", "raw_log", "fingerprint"))
    pair = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(p).alias("pattern")) for k, p in enumerate(("^(?P<message>.*u[0-9]*[02468])$", "^(?P<message>.*)$"), 1)))
    none = {"mapping": F.lit(None).cast("map<string,string>"), "transformations": F.lit(None).cast(TRANSFORMATIONS)}
    rules = m.select(F.col("fingerprint").alias("hash")).distinct().select("hash", F.inline(pair)).withColumns(none)
    return with_first_parsed(m, rules, normalized=False).select("id", "candidate", "error")


# every outcome of vendors and value types, and forms that the corpus lacks: results written out by hand --------------


def cases(values: list[str]) -> str:
    """One of some SQL expressions by event_id."""
    return f"CASE event_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_VENDOR_CASES = [
    ("'%ASA-4-106023: x'", "cisco/asa"), ("'%LINK-3-UPDOWN: x'", "cisco/ios"), ("'devname=\"fgt1\" x'", "fortinet/fortigate"), ("'x THREAT,alert'", "palo_alto/pan_os"), ("'about PAN-OS'", "palo_alto/pan_os"), ("'RT_IDP x'", "juniper/junos"),
    ("'the SMARTDEFENSE x'", "checkpoint/firewall1"), ("'Microsoft-Windows-Security x'", "microsoft/windows_event"), ("'<EventID>' || event_id || '</EventID>'", "microsoft/windows_event"), ("'2 eni-0a1b 10.0.0.1'", "aws/vpc_flow"),
    ("'aws:cloudtrail x'", "aws/cloudtrail"), ("'AzureActivity x'", "microsoft/azure"), ("'sshd[' || event_id || ']: x'", "linux/sshd"), ("'systemd[1]: x'", "linux/systemd"), ("'sudo[1]: x'", "linux/sudo"), ("'cron[9]: x'", "linux/cron"),
    ("'auditd[9]: x'", "linux/auditd"), ("'kernel[9]: x'", "linux/system"), ("event_type", "/"), ("'xsshd[1]: %ASA THREAT, eni-'", "/"),
]


@query(f"SELECT event_id, {cases([O.q(v) for _, v in _VENDOR_CASES])} AS vendor FROM events")
def q_vendor_outcomes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", f"{cases([t for t, _ in _VENDOR_CASES])} as t")
    return e.withColumn("v", N.vendor_product(F.col("t"))).select("event_id", F.concat_ws("/", "v.vendor", "v.product").alias("vendor"))


_VALUE_CASES = [
    ("'True'", "bool"), ("'nil'", "null"), ("'550e8400-e29b-41d4-a716-446655440000'", "uuid"), ("'00:1b:44:11:3a:b7'", "mac"), ("'001b.4411.3ab7'", "mac"), ("'10.0.0.' || event_id % 256", "ipv4"), ("'::1'", "ipv6"), ("md5(event_type)", "hex_hash"),
    ("'HTTPS://x/' || event_id", "url"), ("event_type || '@b.co'", "email"), ("'2024-01-02T03:04:05Z'", "timestamp"), ("'at 03/Feb/2024:03:04:05'", "timestamp"), ("'Feb  3 03:04:05'", "timestamp"), ("'03:04:05.123'", "time"), ("'03:04:05.1234'", "string"), ("'1700000000'", "timestamp"),
    ("'1700000000123'", "timestamp"), ("'-1.5e3'", "number"), ("'Inf'", "number"), ("'0x1p4'", "number"), ("'1e999'", "string"), ("''", "string"), ("'010.0.0.1'", "string"), ("'300.1.1.1'", "string"), ("event_type", "string"), ("'  7 '", "number"),
]


@query(f"SELECT event_id, {cases([O.q(v) for _, v in _VALUE_CASES])} AS kind FROM events")
def q_value_type_outcomes(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_id", f"{cases([t for t, _ in _VALUE_CASES])} as t")
    return e.select("event_id", N.detect_value_type(F.col("t")).alias("kind"))


def _forms_query(name: str, pairs: list[tuple[str, str]]) -> None:
    _canonical_query(name, ["$" + cases([t for t, _ in pairs])], cases([v for _, v in pairs]))


_forms_query(
    "q_stack_forms",
    [
        ("'Traceback (most recent call last):' || chr(10) || '  File \"a.py\", line ' || event_id || chr(10) || 'ValueError: bad'", "'fp-v1:format=multiline|stack=true|prefix=python_stack|lines=Traceback (most recent call last):||File \"a.py\", line <NUMBER>||ValueError: bad'"),
        ("'goroutine ' || event_id || ' [running]:' || chr(10) || 'main.main()'", "'fp-v1:format=multiline|stack=true|prefix=text|lines=goroutine <NUMBER> [running]:||main.main()'"),
        ("event_type || chr(10) || chr(10) || ' two ' || chr(10) || 'three'", "'fp-v1:format=multiline|stack=false|prefix=text|lines=' || event_type || '||two||three'"),
    ],
)
_forms_query(
    "q_kv_forms",
    [
        ("'a: 1 b=\"2 3\" a=x n=' || event_id", "'fp-v1:format=key_value|fields=a:string,b:string,n:number'"),
        ("'z=\"q\\\\\"r\" y=' || event_type || ',x=10.0.0.1'", "'fp-v1:format=key_value|fields=x:ipv4,y:string,z:string'"),
        ("'k= b=' || event_id || ' k=7'", "'fp-v1:format=key_value|fields=b:number,k:string'"),
        ("'word only=' || event_id", "'fp-v1:format=plain_text|template=word only=<NUMBER>'"),
    ],
)
_forms_query(
    "q_csv_forms",
    [
        ("'a1' || chr(9) || event_id || chr(9) || 'x y' || chr(9) || '10.0.0.1'", "'fp-v1:format=csv|delim=' || chr(9) || '|cols=4|header=false|types=string,number,string,ipv4'"),
        ("'a1|' || event_id || '|x|true'", "'fp-v1:format=csv|delim=||cols=4|header=false|types=string,number,string,bool'"),
        ("'\"a,b\",' || event_id || ',\"x \"\"y\"\"\",7'", "'fp-v1:format=csv|delim=,|cols=4|header=false|types=string,number,string,number'"),
        ("'a;b;c;' || event_type", "'fp-v1:format=plain_text|template=a;b;c;' || event_type"),
    ],
)
