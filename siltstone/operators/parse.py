"""Rule-driven extraction: pattern, mapping and transformations applied to raw logs; errors are a column, never exceptions."""

from __future__ import annotations

import json
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.layouts import to_rfc3339
from siltstone.functions.patterns import SPACES
from siltstone.functions.structure import is_number
from siltstone.operators.re2 import Refused, Rule, compiled
from siltstone.sources.scratch import materialized

TARGETS = ["timestamp", "severity", "service", "host", "source", "message", "event_type", "trace_id", "request_id"]
NORMALIZED = T.StructType([*(T.StructField(n, T.StringType()) for n in TARGETS), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
PARSED = T.StructType([T.StructField("normalized", NORMALIZED), T.StructField("error", T.StringType())])
TRANSFORMATIONS = T.MapType(T.StringType(), T.StructType([T.StructField("type", T.StringType()), T.StructField("format", T.StringType())]))


class ParseError(ValueError):
    pass


def compile_rule(pattern: str) -> Rule:
    """The rule of an RE2 pattern; foreign syntax is refused."""
    if not pattern:
        raise ParseError("empty pattern")
    try:
        return compiled(pattern)
    except Refused as e:
        raise ParseError(f"invalid pattern: {e}") from None


def _moment(seconds: int) -> str:
    t = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)
    return f"{t.year:04d}-{t:%m-%dT%H:%M:%SZ}"


def _integer(v: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", v) or not -(1 << 63) <= int(v) < 1 << 63:
        raise ParseError(f"not an integer: {v!r}")
    return int(v)


def _decimal(v: str) -> str:
    if not is_number(v):
        raise ParseError(f"not a number: {v!r}")
    x = float.fromhex(v) if "x" in v.lower() else float(v)
    if x != x or abs(x) == float("inf"):
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    return re.sub(r"\.0\Z", "", format(_exact(x), "f"))


def _exact(x: float):
    from decimal import Decimal

    return Decimal(repr(x))


def transform(value: str, kind: str, layout: str) -> str:
    k = kind.lower()
    one = lambda f: "".join(f(c) if len(f(c)) == 1 else c for c in value)
    if k in ("uppercase", "upper"):
        return one(str.upper)
    if k in ("lowercase", "lower"):
        return one(str.lower)
    if k in ("trim", "trim_space"):
        return value.strip(SPACES)
    if k in ("integer", "int"):
        return str(_integer(value.strip(SPACES)))
    if k in ("float", "decimal", "number"):
        return _decimal(value.strip(SPACES))
    if k in ("datetime", "date", "timestamp", "time"):
        out = to_rfc3339(value, layout or "")
        if out is None:
            raise ParseError(f"no such datetime: {value!r}")
        return out
    try:
        if k in ("epoch_s", "epoch_sec", "unix"):
            return _moment(_integer(value.strip(SPACES)))
        if k in ("epoch_ms", "epoch_milli"):
            return _moment(_integer(value.strip(SPACES)) // 1000)
    except OverflowError:
        raise ParseError(f"out of range: {value!r}") from None
    raise ParseError(f"unknown transformation {kind!r}")


def parse_one(raw: str | None, pattern: str | None, mapping: dict | None, steps: dict | None) -> tuple[dict | None, str | None]:
    """(normalized, None) or (None, error) of one log. Captures that share a target: by capture name, the last one stays."""
    try:
        if pattern is None:
            raise ParseError("no rule")
        raw = raw or ""
        found = compile_rule(pattern).match(raw)
        if found is None:
            raise ParseError("no match")
        whole, fields = found
        if whole != raw:
            raise ParseError("partial match")
        out: dict = dict.fromkeys(TARGETS[:7], "") | {"trace_id": None, "request_id": None, "metadata": {}}
        pairs = sorted((mapping or {}).items()) or [(k, k) for k in sorted(fields)]
        for name, target in pairs:
            if name not in fields:
                raise ParseError(f"field {name!r} is not captured")
            step = (steps or {}).get(name) or ((steps or {}).get(target) if mapping else None)
            value = transform(fields[name], step["type"] or "", step["format"]) if step else fields[name]
            if target in TARGETS:
                out[target] = value or None if target in TARGETS[7:] else value
            else:
                out["metadata"][target.removeprefix("metadata.")] = value
        return out, None
    except ParseError as e:
        return None, str(e)


@F.pandas_udf(PARSED)
def parse_log(raw: pd.Series, pattern: pd.Series, mapping: pd.Series, steps: pd.Series) -> pd.DataFrame:
    rows = []
    for r, p, m, s in zip(raw, pattern, mapping, steps, strict=True):
        rows.append(parse_one(r, p, dict(m) if m is not None else None, {k: dict(v) for k, v in dict(s).items()} if s is not None else None))
    return pd.DataFrame({"normalized": pd.Series([n for n, _ in rows], dtype=object), "error": pd.Series([e for _, e in rows], dtype=object)})


_CANDIDATES = T.StructType([*PARSED.fields, T.StructField("candidate", T.IntegerType())])
_CHOICE = T.StructType(_CANDIDATES.fields[1:])


@lru_cache(maxsize=4096)
def candidates(listed: str) -> tuple[tuple[str | None, dict, dict], ...]:
    """Pattern, mapping and transformations of each rule of a list, which logs of one hash share: read once, not once a log."""
    steps = lambda t: {"type": t.get("type"), "format": t.get("format")}
    return tuple((c.get("pattern"), {e["key"]: e.get("value") for e in c.get("m", ())}, {e["key"]: steps(e["value"]) for e in c.get("t", ()) if "value" in e}) for c in json.loads(listed))


def first_of(raw: str | None, listed: str | None) -> tuple[dict | None, str | None, int | None]:
    """The result of the first candidate rule that takes the whole log, and its number from 1; else the first one's error."""
    out = (None, "no rule", None)
    for k, rule in enumerate(candidates(listed) if listed is not None else (), 1):
        normalized, error = parse_one(raw, *rule)
        if error is None:
            return normalized, None, k
        out = (None, error, None) if k == 1 else out
    return out


@F.pandas_udf(_CANDIDATES)
def parse_first(raw: pd.Series, listed: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(first_of, raw, listed)), columns=_CANDIDATES.fieldNames(), dtype=object)


@F.pandas_udf(_CHOICE)
def choose_first(raw: pd.Series, listed: pd.Series) -> pd.DataFrame:
    """parse_first without the normalized log, which takes longer to hand over than to make."""
    return pd.DataFrame([first_of(r, c)[1:] for r, c in zip(raw, listed, strict=True)], columns=_CHOICE.fieldNames(), dtype=object)


def with_first_parsed(df: DataFrame, rules: DataFrame, raw: str = "raw_log", normalized: bool = True) -> DataFrame:
    """df (with fingerprint) parsed by the rules of its hash (hash, rank, pattern, mapping, transformations), tried by rank:
    logs of different kinds that share a fingerprint each find theirs. Adds error, candidate and, if asked, normalized.

    A hash has few rules: they travel as one text. Materialised: Spark knows their size before it joins, and the logs need no
    exchange, which would deal them by a few hashes, unless the rules are many.
    """
    own = F.array_sort(F.collect_list(F.struct("rank", "pattern", F.map_entries("mapping").alias("m"), F.map_entries("transformations").alias("t"))))
    listed = materialized(rules.groupBy(F.col("hash").alias("_hash")).agg(F.to_json(own).alias("_rules")), "candidates")
    parse, made = (parse_first, _CANDIDATES) if normalized else (choose_first, _CHOICE)
    found = df.join(listed, df["fingerprint"] == listed["_hash"], "left").withColumn("_p", parse(F.col(raw), F.col("_rules")))
    return found.withColumns({n: F.col(f"_p.{n}") for n in made.fieldNames()}).drop("_p", "_hash", "_rules")


def with_parsed(df: DataFrame, raw: str = "raw_log") -> DataFrame:
    """Adds normalized and error from the columns pattern, mapping and transformations."""
    done = df.withColumn("_p", parse_log(F.col(raw), "pattern", "mapping", "transformations"))
    return done.withColumn("normalized", F.col("_p.normalized")).withColumn("error", F.col("_p.error")).drop("_p")
