"""Queries over requests, logs and rules: statistics, pages, search, facets and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.normalize import trim_space
from siltstone.sources.logs import STATUSES


def user_stats(requests: DataFrame) -> DataFrame:
    """Per user: requests by status, their total and the last activity, in one aggregation."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return requests.groupBy("user_id").agg(*counts, F.count_if(F.col("status").isin(STATUSES)).alias("total"), F.max("created_at").alias("last_activity"))


def by_user(requests: DataFrame, user_id: int, status: str = "") -> DataFrame:
    found = requests.where(F.col("user_id") == user_id)
    return found if status in ("", "all") else found.where(F.col("status") == status)


def page_bounds(page: int, limit: int) -> tuple[int, int]:
    """Page and limit as the interface accepts them."""
    return max(page, 1), limit if 1 <= limit <= 100 else 25


def newest_page(requests: DataFrame, page: int = 1, limit: int = 25) -> DataFrame:
    page, limit = page_bounds(page, limit)
    return requests.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((page - 1) * limit).limit(limit)


def total_pages(total: int, limit: int) -> int:
    return -(-total // page_bounds(1, limit)[1])


def with_logs(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Requests with the array of their logs; empty where there are none."""
    own = logs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("hash", "normalized.message"))).alias("logs"))
    return requests.join(own, "id", "left").withColumn("logs", F.coalesce("logs", F.array().cast("array<struct<hash:string,message:string>>")))


def with_any_log_of(requests: DataFrame, logs: DataFrame, fingerprint: str) -> DataFrame:
    return requests.join(logs.where(F.col("hash") == fingerprint), "id", "left_semi")


def search_logs(rows: DataFrame, text: str) -> DataFrame:
    """Case-insensitive search in payload, id, status and the normalised log as JSON."""
    low = F.lower(F.lit(text))
    hit = lambda c: F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), low)
    parts = [F.col("raw_log"), F.col("id"), F.col("status")] + ([F.to_json("normalized")] if "normalized" in rows.columns else [])
    cond = hit(parts[0])
    for p in parts[1:]:
        cond = cond | hit(p)
    return rows.where(cond)


def search_rules(rules: DataFrame, text: str = "", status: str = "", fmt: str = "") -> DataFrame:
    """Case-insensitive search in name, format, vendor, product, hash, pattern, sample and fields; then by status and format."""
    shown = F.concat_ws(" ", "name", F.coalesce("format", F.lit("Custom")), "vendor", "product", "hash", "pattern", "sample_log", F.array_join(fields_of(), " "))
    found = rules.where(F.contains(F.lower(shown), F.lower(F.lit(text))))
    if status:
        found = found.where(F.lower(F.coalesce("status", F.lit("Active"))) == status.lower())
    return found.where(F.lower(F.coalesce("format", F.lit("Custom"))) == fmt.lower()) if fmt else found


def rule_metrics(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("rules"), F.count_if(F.lower(F.coalesce("status", F.lit("Active"))) == "active").alias("active"), F.coalesce(F.sum("logs_processed"), F.lit(0)).alias("processed"))


def formats(rules: DataFrame) -> DataFrame:
    return rules.select(F.coalesce("format", F.lit("Custom")).alias("format")).distinct()


def top_rules(rules: DataFrame, n: int = 6) -> DataFrame:
    """The rules used most, with the share of the largest for the bar's width."""
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("format"), F.lit("Unnamed"))
    top = rules.where("logs_processed > 0").select(name.alias("label"), "hash", "logs_processed").orderBy(F.col("logs_processed").desc(), "hash").limit(n)
    return top.withColumn("share", F.col("logs_processed") / F.max("logs_processed").over(Window.partitionBy(F.lit(1))))


def preview(payload: Column, n: int) -> Column:
    line = trim_space(F.substring_index(payload, "\n", 1))
    return F.when(F.char_length(line) > n, F.concat(F.left(line, F.lit(n)), F.lit("…"))).otherwise(line)


def time_ago(at: Column, now: Column) -> Column:
    s = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at.cast("timestamp"))
    part = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s < 60, "Just now").when(s < 3600, part(60, " min ago")).when(s < 86400, part(3600, " hr ago")).when(s < 604800, part(86400, " days ago")).otherwise(F.date_format(at, "yyyy-MM-dd"))


def fields_of() -> Column:
    """A rule's extracted fields, or else the keys of its mapping."""
    return F.coalesce("extracted_fields", F.array_sort(F.map_keys("mapping")))


def field_chips(rules: DataFrame) -> DataFrame:
    return rules.select("hash", F.array_join(fields_of(), ", ").alias("fields"))


def find_rule(rules: DataFrame, key: str) -> DataFrame:
    """By id (24 hexadecimal digits) or else by fingerprint."""
    by_id = F.lit(key).rlike(r"^[0-9a-fA-F]{24}\z")
    return rules.where(F.when(by_id, F.col("id") == key).otherwise(F.col("hash") == key) if "id" in rules.columns else F.col("hash") == key)


def clock(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "dd/MM/yyyy, HH:mm:ss"), F.lit("—"))


def count_of(requests: DataFrame, user_id: int, status: str = "") -> DataFrame:
    """How many rows by_user finds, for the number of pages."""
    return by_user(requests, user_id, status).agg(F.count("*").alias("total"))


def request_of(requests: DataFrame, request_id: int, user_id: int) -> DataFrame:
    """One user's request by its id; others' are not found."""
    return requests.where((F.col("id") == request_id) & (F.col("user_id") == user_id))


def first_logs(requests: DataFrame, logs: DataFrame) -> DataFrame:
    """Requests with level, service and message of their first log (the smallest hash); what is empty falls back to a dash,
    a message to the payload first."""
    first = logs.groupBy("id").agg(F.min_by(F.struct(*(F.col(f"normalized.{c}").alias(c) for c in ("severity", "service", "message"))), "hash").alias("_first"))
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    dash = F.lit("—")
    shown = {"level": F.coalesce(some("_first.severity"), dash), "service": F.coalesce(some("_first.service"), dash), "message": F.coalesce(some("_first.message"), some("raw_log"), dash)}
    return requests.join(first, "id", "left").withColumns(shown).drop("_first")


def pretty(normalized: Column, names: list[str]) -> Column:
    """A normalised log as indented JSON: fields in the order of `names`, nulls left out, metadata by key at the end."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    line = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit("  "), quoted(key), F.lit(": "), quoted(c)))
    extra = F.transform(F.array_sort(F.map_entries(normalized["metadata"])), lambda e: F.concat(F.lit("  "), line(e["key"], F.coalesce(e["value"], F.lit("")))))
    block = F.when(F.size(extra) > 0, F.concat(F.lit('  "metadata": {\n'), F.array_join(extra, ",\n"), F.lit("\n  }")))
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *(line(F.lit(n), normalized[n]) for n in names), block), F.lit("\n}"))


def rule_options(rules: DataFrame) -> DataFrame:
    """Choices of a rule filter: value (hash or else name) and label (name or else hash), and one for all."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    own = rules.select(F.coalesce(some("hash"), some("name")).alias("value"), F.coalesce(some("name"), some("hash")).alias("label"))
    every = rules.sparkSession.range(1).select(F.lit("all").alias("value"), F.lit("All rules").alias("label"))
    return every.unionByName(own.where("value is not null"))


def tag_counts(logs: DataFrame, raw: str = "raw_log") -> DataFrame:
    """Opening tags of all logs by name."""
    return logs.select(F.explode(F.regexp_extract_all(F.col(raw), F.lit(r"<([A-Za-z_][\w.\-]*)(?=[\s/>])"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
