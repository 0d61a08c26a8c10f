"""Parsing rules: default synthesis, manual creation, upsert by fingerprint."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import reduce
from threading import Thread
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.features import FEATURES
from siltstone.functions.normalize import trim_space
from siltstone.functions.patterns import DEFAULT_RULES, java
from siltstone.operators.parse import ParseError, compile_rule
from siltstone.sources.scratch import materialized

RULE = "struct<name:string,pattern:string,mapping:map<string,string>,transformations:map<string,struct<type:string,format:string>>>"
COLUMNS = ["hash", "name", "pattern", "mapping", "transformations", "status", "format", "vendor", "product", "template", "delimiter", "extracted_fields", "field_signatures", "sample_log", "logs_processed", "last_used", "created_at", "updated_at"]


def _rule(name: str, pattern: str, layout: str | None, transforms: bool) -> Column:
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    mapping = F.create_map(*[F.lit(x) for n in names for x in (n, n)])
    step = lambda kind, fmt: F.struct(F.lit(kind).alias("type"), F.lit(fmt).alias("format"))
    steps = F.create_map(F.lit("severity"), step("uppercase", ""), F.lit("timestamp"), step("datetime", layout or "")) if transforms else F.lit(None)
    return F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"), mapping.alias("mapping"), steps.alias("transformations")).cast(RULE)


def default_rule(raw: Column) -> Column:
    """The first of the four default rules whose pattern fits the trimmed log."""
    t = trim_space(raw)
    named = lambda p: re.sub(r"\(\?P<\w+>", "(", p)
    out = None
    for name, pattern, layout, transforms in DEFAULT_RULES[:-1]:
        cond = t.rlike(java(named(pattern)))
        out = F.when(cond, _rule(name, pattern, layout, transforms)) if out is None else out.when(cond, _rule(name, pattern, layout, transforms))
    return out.otherwise(_rule(*DEFAULT_RULES[-1]))


def manual_key(pattern: Column) -> Column:
    """Key of a rule made by hand; logs' fingerprints are longer, so no log selects it."""
    return F.left(F.sha2(pattern, 256), F.lit(16))


def valid(pattern: str) -> bool:
    try:
        compile_rule(pattern)
    except ParseError:
        return False
    return True


@F.pandas_udf(T.BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    return pd.Series([p is not None and valid(p) for p in patterns], dtype=bool)


def valid_rules(rules: DataFrame) -> DataFrame:
    """Rules whose pattern compiles; empty, null and foreign patterns go."""
    return rules.where(_compiles("pattern"))


def patched(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """rules with the non-empty values of changes (hash and any other columns of rules, one row a hash) in place of theirs."""
    named = [c for c in changes.columns if c != "hash"]
    new = changes.select(F.col("hash"), F.struct(*named).alias("_new"))
    value = lambda c: F.coalesce(F.when(F.col(f"_new.{c}").cast("string") != "", F.col(f"_new.{c}")), F.col(c)).alias(c)
    texts = {f.name for f in rules.schema.fields if f.dataType.simpleString() in ("string", "bigint", "timestamp")}
    kept = lambda c: value(c) if c in texts else F.coalesce(F.col(f"_new.{c}"), F.col(c)).alias(c)
    return rules.join(new, "hash", "left").select(*(kept(c) if c in named else c for c in rules.columns))


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """rows but those whose key stands in ids."""
    return rows.join(ids.select(key), key, "left_anti")


class Remote(NamedTuple):
    """A synthesiser outside Spark: hook(raw_log, features as JSON) gives name, pattern, mapping and transformations, or None.

    Each task asks for at most `in_flight` rules at a time and waits `seconds` for each; an error, a late answer or one of
    another form counts as none. A task with `in_flight` calls that never came back asks no more.
    """

    hook: Callable[[str, str | None], dict | None]
    seconds: float = 10.0
    in_flight: int = 8


_ANSWER = "fingerprint string, name string, pattern string, mapping map<string,string>, transformations map<string,struct<type:string,format:string>>"


def answers(missing: DataFrame, remote: Remote) -> DataFrame:
    """fingerprint and _r (null without an answer) of missing's rows; one call each, so the result is materialised."""
    hook, seconds, in_flight = remote

    def ask(raw: str, features: str | None, out: list, at: int) -> None:
        try:
            found = hook(raw, features)
            steps = {str(k): {"type": str(v["type"]), "format": str(v.get("format") or "")} for k, v in (found.get("transformations") or {}).items()}
            out[at] = (str(found.get("name") or ""), str(found["pattern"]), {str(k): str(v) for k, v in (found.get("mapping") or {}).items()}, steps)
        except Exception:  # whatever the other side does, the default rule stands in
            out[at] = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hung = 0
        for pdf in batches:
            out: list = [None] * len(pdf)
            for s in range(0, len(pdf), in_flight):
                if hung >= in_flight:
                    break
                part = range(s, min(s + in_flight, len(pdf)))
                calls = [Thread(target=ask, args=(pdf["raw_log"].iloc[i], pdf["features"].iloc[i], out, i), daemon=True) for i in part]
                end = time.monotonic() + seconds
                for c in calls:
                    c.start()
                for c in calls:
                    c.join(max(0.0, end - time.monotonic()))
                hung += sum(c.is_alive() for c in calls)
            rows = [(f, *(a or (None,) * 4)) for f, a in zip(pdf["fingerprint"], list(out), strict=True)]
            yield pd.DataFrame(rows, columns=["fingerprint", "name", "pattern", "mapping", "transformations"], dtype=object)

    features = F.to_json("features") if "features" in missing.columns else F.lit(None).cast("string")
    told = materialized(missing.select("fingerprint", "raw_log", features.alias("features")).mapInPandas(run, _ANSWER), "answers")
    return told.select("fingerprint", F.when(F.col("pattern").isNotNull(), F.struct("name", "pattern", "mapping", "transformations").cast(RULE)).alias("_r"))


def synthesize(missing: DataFrame, rule=default_rule) -> DataFrame:
    """A rule row for each (fingerprint, raw_log, format, vendor, product, template, and features if there); `rule` is the
    pluggable synthesiser (a Column function or a Remote), and where it gives null or a pattern that does not compile the
    default rule stands in."""
    if rule is default_rule:
        r = missing.withColumn("_r", default_rule(F.col("raw_log")))
    elif isinstance(rule, Remote):
        r = missing.join(answers(missing, rule), "fingerprint", "left")
        r = r.withColumn("_r", F.when(_compiles("_r.pattern"), F.col("_r")).otherwise(default_rule(F.col("raw_log"))))
    else:
        r = missing.withColumn("_r", rule(F.col("raw_log")).cast(RULE))
        r = r.withColumn("_r", F.when(_compiles("_r.pattern"), F.col("_r")).otherwise(default_rule(F.col("raw_log"))))
    if "features" not in missing.columns:
        r = r.withColumn("features", F.lit(None).cast(FEATURES))
    other = F.when(F.col("format") == "unknown", "Custom").otherwise(F.col("format"))
    keys = F.col("features.keys")
    made = {
        "hash": F.col("fingerprint"),
        **{c: F.col(f"_r.{c}") for c in ("name", "pattern", "mapping", "transformations")},
        "status": F.lit("Active"),
        "format": other,
        **{c: F.col(c) for c in ("vendor", "product", "template")},
        "delimiter": F.col("features.delimiter"),
        "extracted_fields": F.when(F.size(keys) > 0, keys).otherwise(F.array_sort(F.map_keys("_r.mapping"))),
        "field_signatures": F.col("features.field_signatures"),
        "sample_log": F.col("raw_log"),
        "logs_processed": F.lit(0).cast("long"),
        **{c: F.lit(None).cast("timestamp") for c in ("last_used", "created_at", "updated_at")},
    }
    return r.select(*(made[c].alias(c) for c in COLUMNS))


def given_name() -> Column:
    """The first that a nameless rule has of product, vendor and format (unless unknown), each with `Parser` behind it;
    then Parser-<hash8>, then CustomParser."""
    full = lambda c: F.when(F.col(c) != "", F.concat(F.col(c), F.lit("Parser")))
    shape = F.when(F.col("format") != "unknown", full("format"))
    return F.coalesce(F.when(F.col("name") != "", F.col("name")), full("product"), full("vendor"), shape, F.when(F.col("hash") != "", F.concat(F.lit("Parser-"), F.left("hash", F.lit(8)))), F.lit("CustomParser"))


def upsert(rules: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """rules with new rows merged by hash: pattern, mapping, transformations, format and status are replaced; names, vendor,
    product, template, delimiter, fields and sample only by values that say something; counters and created_at stay,
    updated_at becomes `now`. A new rule is created and last used now."""
    now = F.current_timestamp() if now is None else now
    fresh = new.withColumn("name", given_name()).withColumn("status", F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("Active"))).withColumn("format", F.coalesce(F.when(F.col("format") != "", F.col("format")), F.lit("Custom")))
    once = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("hash").orderBy("pattern"))).where("_n = 1").drop("_n")
    o, n = rules.alias("o"), once.alias("n")
    joined = o.join(n, F.col("o.hash") == F.col("n.hash"), "full_outer")
    both = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    says = lambda c: F.coalesce(F.when(F.col(f"n.{c}") != "", F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    weak = F.col("n.name").isin("CustomParser") | (F.col("n.name") == F.concat(F.lit("Parser-"), F.left(F.col("n.hash"), F.lit(8))))
    name = F.when(F.col("n.hash").isNull() | (weak & (F.col("o.name") != "")), F.col("o.name")).otherwise(F.col("n.name")).alias("name")
    kept = lambda c: F.when(F.col("o.hash").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    steps = F.when(F.col("n.hash").isNotNull(), F.col("n.transformations")).otherwise(F.col("o.transformations")).alias("transformations")
    some = lambda c: F.coalesce(F.when(F.size(F.col(f"n.{c}")) > 0, F.col(f"n.{c}")), F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    first = lambda c: F.when(F.col("o.hash").isNull(), F.coalesce(F.col(f"n.{c}"), now)).otherwise(F.col(f"o.{c}")).alias(c)
    moved = F.when(F.col("n.hash").isNull(), F.col("o.updated_at")).otherwise(now).alias("updated_at")
    texts = [says(c) for c in ("vendor", "product", "template", "delimiter")]
    lists = [some("extracted_fields"), some("field_signatures"), says("sample_log")]
    return joined.select(both("hash"), name, both("pattern"), both("mapping"), steps, both("status"), both("format"), *texts, *lists, kept("logs_processed"), first("last_used"), first("created_at"), moved)


def count_usage(rules: DataFrame, completed: DataFrame) -> DataFrame:
    """logs_processed and last_used moved on by the completed logs (fingerprint, at)."""
    used = completed.groupBy(F.col("fingerprint").alias("hash")).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    return rules.join(used, "hash", "left").withColumn("logs_processed", F.col("logs_processed") + F.coalesce("_n", F.lit(0))).withColumn("last_used", F.greatest("_at", "last_used")).drop("_n", "_at").select(rules.columns)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
