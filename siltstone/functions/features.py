"""Format, canonical form, fingerprint and feature record of raw logs.

A native router decides what needs Python: only rows that may be nested (JSON, XML, CEF, LEEF, key-value, delimited,
structured data) reach the Arrow UDF, and every text meets it once. Syslog headers, multiline signatures, templates,
vendor hints, the canonical string and its hash are Column expressions.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import patterns as P
from siltstone.functions import structure as S
from siltstone.functions.normalize import built, due, finished, first_bytes, normalize_template, seen_in, stepped, structural_tokens, trim_space, vendor_product

VERSION = "fp-v1"


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def nested(text: str | None, syslog: bool) -> tuple | None:
    """The first nested form the text has, in the order of precedence; None leaves it to the native formats."""
    if text is None:
        return None
    try:
        for mark, form in (("CEF:", "cef"), ("LEEF:", "leef")):
            if mark in text and (found := getattr(S, form)(text)):
                return (form, *found)
        if tail := S.json_schema(text):
            return ("json", tail, None, None)
        if syslog:
            return None
        if text[:1] == "<" and text[-1:] == ">" and not text.startswith("<0>") and (tail := S.xml_paths(text)):
            return ("xml", tail, None, None)
        if "\n" in text:
            return None
        if "=" in text and (tail := S.kv(text)):
            return ("key_value", tail, None, None)
        if tail := S.delimited(text):
            return ("csv", tail, None, None)
    except Exception:
        return ("unknown", None, None, None)  # one odd text never fails the job
    return None


@F.pandas_udf(_strings("format", "tail", "vendor", "product"))
def nested_udf(texts: pd.Series, syslog: pd.Series) -> pd.DataFrame:
    rows = [nested(t, s) or (None,) * 4 for t, s in zip(texts, syslog, strict=True)]
    return pd.DataFrame(rows, columns=["format", "tail", "vendor", "product"], dtype=object)


_LIST = T.ArrayType(T.StringType())
_RECORD = T.StructType([*_strings("format", "tail", "vendor", "product").fields, T.StructField("keys", _LIST), T.StructField("types", _LIST), T.StructField("own", _LIST)])


@F.pandas_udf(_RECORD)
def nested_record_udf(texts: pd.Series, syslog: pd.Series) -> pd.DataFrame:
    """nested_udf with the keys, their types and the form's own fields."""
    rows = []
    for t, s in zip(texts, syslog, strict=True):
        found = nested(t, s)
        rows.append((None,) * 7 if found is None else (*found, *(S.details(found[0], t) if found[0] != "unknown" else ([], [], []))))
    return pd.DataFrame(rows, columns=_RECORD.fieldNames(), dtype=object)


@F.pandas_udf(T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), *_strings("body").fields]))
def structured_udf(rest: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if r is None else S.structured_data(r) for r in rest]
    return pd.DataFrame(rows, columns=["keys", "body"], dtype=object)


def syslog_parts(t: Column) -> Column:
    """struct of a syslog text's header fields and body; null where it is none."""
    group = lambda p, i: F.regexp_extract(t, P.java(p), i)
    number = lambda c: F.coalesce(c.try_cast("bigint"), F.lit(0))
    pri = F.regexp_extract(t, "^<([0-9]{1,3})>", 1).try_cast("int")
    fac, sev = F.floor(pri / 8).cast("int"), pri % 8
    zero, none, yes, no = F.lit(0), F.lit(""), F.lit(True), F.lit(False)

    def made(kind: str, ver: Column, f: Column, s: Column, app: Column, msg: Column, body: Column, dated: Column, host: Column, pid: Column) -> Column:
        parts = {"ver": ver.cast("bigint"), "fac": f.cast("int"), "sev": s.cast("int"), "app": app, "msg_id": msg, "body": body, "kind": F.lit(kind), "has_timestamp": dated, "has_hostname": host, "has_pid": pid}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    whole = F.regexp_extract(t, P.java(P.RFC5424), 0)
    v5424 = made("rfc5424", number(group(P.RFC5424, 2)), fac, sev, group(P.RFC5424, 5), group(P.RFC5424, 7), trim_space(F.substr(t, F.char_length(whole) + 1)), *(group(P.RFC5424, i) != "-" for i in (3, 4, 6)))
    v3164 = made("rfc3164", zero, fac, sev, group(P.RFC3164, 4), none, group(P.RFC3164, 6), yes, yes, group(P.RFC3164, 5) != "")
    generic = made("", zero, fac, sev, none, none, F.regexp_replace(t, "^<[0-9]{1,3}>", ""), no, no, no)
    bsd = made("bsd", zero, zero, zero, group(P.BSD, 3), none, group(P.BSD, 5), yes, yes, group(P.BSD, 4) != "")
    dated = (F.octet_length(t) >= 16) & F.substring(t, 1, 16).rlike(P.java(P.SYSLOG_TS))
    return (
        F.when(t.startswith("<") & (pri <= 191), F.when(t.rlike(P.java(P.RFC5424)), v5424).when(t.rlike(P.java(P.RFC3164)), v3164).otherwise(generic))
        .when(~t.startswith("<") & dated & t.rlike(P.java(P.BSD)), bsd)
    )


def multiline_parts(t: Column) -> Column:
    """struct of a text of several lines: stack, prefix, signs (of its significant lines) and lines (how many)."""
    lines = F.filter(F.transform(F.split(t, "\n"), trim_space), lambda x: x != "")
    stack = reduce(lambda a, b: a | b, (t.rlike(P.java(p)) for p in P.STACK))

    def mark(line: Column, i: Column) -> Column:
        at, keep = line.startswith("at "), line.startswith("Caused by: ") | line.startswith("File ") | (i < 5)
        return F.when((i > 0) & at, F.substring_index(line, "(", 1)).when((i == 0) | keep, normalize_template(line))

    signs = F.filter(F.transform(lines, mark), lambda x: x.isNotNull())
    kinds = F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.when(x.startswith("at "), "java_stack").when(x.startswith("File ") & ~x.startswith("Caused by: "), "python_stack"))
    last = F.element_at(F.filter(kinds, lambda x: x.isNotNull()), -1)
    some = F.size(F.filter(kinds, lambda x: x.isNotNull())) > 0
    return F.struct(stack.alias("stack"), F.when(some, last).otherwise("text").alias("prefix"), signs.alias("signs"), F.size(lines).alias("lines"))


#: The feature record of a log; the structs of other formats than its own are null, a JSON schema is in its canonical form.
FEATURES = (
    "struct<version:string,format:string,delimiter:string,field_count:int,keys:array<string>,field_signatures:array<struct<key:string,type:string>>,json_schema:string,xml_hierarchy:string,"
    "syslog:struct<version:bigint,facility:int,severity:int,app_name:string,msg_id:string,structured_keys:array<string>,has_timestamp:boolean,has_hostname:boolean,has_pid:boolean>,"
    "cef:struct<version:bigint,device_vendor:string,device_product:string,device_version:string,device_event_class_id:string,severity:string,extension_fields:array<struct<key:string,type:string>>>,"
    "leef:struct<version:string,vendor:string,product:string,product_version:string,event_id:string,delimiter:string,extension_fields:array<struct<key:string,type:string>>>,"
    "csv:struct<delimiter:string,column_count:int,has_header:boolean,header_names:array<string>,column_types:array<string>,quote_char:string>,"
    "kv:struct<separator:string,delimiter:string,fields:array<struct<key:string,type:string>>,quoting_style:string,has_duplicates:boolean>,"
    "multiline:struct<line_count:int,is_stack_trace:boolean,prefix_type:string,line_signatures:array<string>>,"
    "vendor_hint:string,product_hint:string,template:string,structural_tokens:array<string>>"
)


def feature_record() -> Column:
    """FEATURES of a row that with_fingerprint has taken apart."""
    fmt, own, n, log, lines = F.col("format"), F.col("_nested.own"), F.col("_nested"), F.col("_syslog"), F.col("_lines")
    is_a = lambda *names: fmt.isin(*names)
    none = F.array().cast("array<string>")
    keys = F.when(is_a("syslog"), F.coalesce(F.col("_sd.keys"), none)).otherwise(F.coalesce(n["keys"], none))
    pairs = F.when(is_a("json", "cef", "leef", "key_value"), F.arrays_zip(n["keys"].alias("key"), n["types"].alias("type"))).otherwise(F.array())
    pairs = pairs.cast("array<struct<key:string,type:string>>")
    tokens = (
        F.when(is_a("plain_text"), structural_tokens(F.col("template")))
        .when(is_a("syslog") & (log["kind"] == "rfc5424"), F.array(F.lit("syslog"), log["kind"], log["app"], log["msg_id"]))
        .when(is_a("syslog") & (log["kind"] != ""), F.array(F.lit("syslog"), log["kind"], log["app"]))
        .otherwise(none)
    )
    base = F.when(log["kind"] == "rfc5424", 5).when(log["kind"] == "rfc3164", 4).when(log["kind"] == "bsd", 3).otherwise(0)
    count = (
        F.when(is_a("syslog"), F.size(keys) + base)
        .when(is_a("cef"), F.size(keys) + 7)
        .when(is_a("leef"), F.size(keys) + 5)
        .when(is_a("csv"), F.size(n["types"]))
        .when(is_a("multiline"), F.size(lines["signs"]))
        .when(is_a("plain_text"), F.size(tokens))
        .otherwise(F.size(keys))
    )
    named = lambda form, names, *more: F.when(is_a(form), F.struct(*(own[i].alias(x) for i, x in enumerate(names)), *more))
    after = lambda mark: F.substring_index(n["tail"], mark, -1) if mark == "|hierarchy=" else F.substr(n["tail"], F.lit(len(mark) + 1))
    fields = {
        "version": F.lit(VERSION),
        "format": fmt,
        "delimiter": F.when(is_a("cef", "leef"), "|").when(is_a("csv"), own[0]).when(is_a("key_value"), own[1]).otherwise(""),
        "field_count": count,
        "keys": keys,
        "field_signatures": pairs,
        "json_schema": F.when(is_a("json"), after("|schema=")),
        "xml_hierarchy": F.when(is_a("xml"), after("|hierarchy=")),
        "syslog": F.when(is_a("syslog"), F.struct(log["ver"], log["fac"], log["sev"], log["app"], log["msg_id"], keys, log["has_timestamp"], log["has_hostname"], log["has_pid"])),
        "cef": named("cef", ("version", "vendor", "product", "device_version", "class", "severity"), pairs),
        "leef": named("leef", ("version", "vendor", "product", "product_version", "event_id", "delimiter"), pairs),
        "csv": F.when(is_a("csv"), F.struct(own[0], F.size(n["types"]), own[1] == "true", n["keys"], n["types"], F.lit(""))),
        "kv": F.when(is_a("key_value"), F.struct(own[0], own[1], pairs, own[2], own[3] == "true")),
        "multiline": F.when(is_a("multiline"), F.struct(lines["lines"], lines["stack"], lines["prefix"], lines["signs"])),
        "vendor_hint": F.col("vendor"),
        "product_hint": F.col("product"),
        "template": F.col("template"),
        "structural_tokens": tokens,
    }
    # each field is cast by itself: a cast of the whole would hide from Spark which fields a query reads
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(FEATURES).fields}
    return F.struct(*(v.cast(kinds[k]).alias(k) for k, v in fields.items()))


def _seen_first(body: Column) -> Column:
    return seen_in(first_bytes(body))


def _template_of(body: Column, seen: Column, numbers: Column) -> Column:
    return finished(body, stepped(seen["text"], numbers))


def with_fingerprint(df: DataFrame, raw_col: str = "raw_log", record: bool = False) -> DataFrame:
    """df with format, vendor, product, template, canonical and fingerprint of its raw logs (null counts as empty), and
    with `record` their FEATURES as `features`.

    The nested parts are computed before anything filters on the results, so the template fold runs once a row.
    """
    raw = F.coalesce(F.col(raw_col), F.lit(""))
    text = trim_space(raw)
    many = F.lit(False)
    for d in (",", "\t", "|", ";"):
        many = many | (F.char_length("_t") - F.char_length(F.replace(F.col("_t"), F.lit(d))) >= 3)
    maybe = F.col("_t").rlike(r"^[\[{<]|CEF:|LEEF:|=") | many
    step1 = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), text.alias("_t")).withColumn("_syslog", built(syslog_parts, "_t"))
    is_syslog = F.col("_syslog").isNotNull()
    step1 = step1.withColumn("_nested", (nested_record_udf if record else nested_udf)(F.when(maybe, F.col("_t")), is_syslog)).withColumn(
        "_sd", structured_udf(F.when((F.col("_syslog.ver") > 0) & F.col("_syslog.body").startswith("["), F.col("_syslog.body")))
    )
    fmt = (
        F.when(F.col("_t") == "", "unknown")
        .when(F.col("_nested.format").isNotNull(), F.col("_nested.format"))
        .when(is_syslog, "syslog")
        .when(F.contains(F.col("_t"), F.lit("\n")), "multiline")
        .otherwise("plain_text")
    )
    step2 = step1.withColumn("format", fmt).withColumn("_vp", built(vendor_product, "_t")).withColumn("_lines", F.when(F.col("format") == "multiline", built(multiline_parts, "_t")))
    native = F.col("format").isin("syslog", "plain_text") | ((F.col("format") == "unknown") & (F.col("_t") != ""))
    body = F.when(F.col("format") == "syslog", F.coalesce(F.col("_sd.body"), F.col("_syslog.body"))).otherwise(F.col("_t"))
    own = F.col("format").isin("cef", "leef")
    step3 = (
        step2.withColumn("_body", F.when(native, body))
        # what the steps need is looked up by columns of their own, which Spark compiles; inside a lambda it interprets them
        .withColumn("_seen", built(_seen_first, "_body"))
        .withColumn("_due", built(due, "_seen"))
        .withColumn("vendor", F.when(own, F.col("_nested.vendor")).when(F.col("format") == "unknown", "").otherwise(F.col("_vp.vendor")))
        .withColumn("product", F.when(own, F.col("_nested.product")).when(F.col("format") == "unknown", "").otherwise(F.col("_vp.product")))
        .withColumn("template", F.when(native, built(_template_of, "_body", "_seen", "_due")).when(F.col("format") == "multiline", F.col("_lines.signs")[0]).otherwise(""))
    )
    optional = lambda mark, c: F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")
    s = "_syslog."
    head = F.format_string("|ver=%d|fac=%d|sev=%d|app=%s|msg_id=%s", *(F.col(s + x) for x in ("ver", "fac", "sev", "app", "msg_id")))
    tail = (
        F.when(F.col("format") == "syslog", F.concat(head, optional("|sd=", F.coalesce(F.array_join("_sd.keys", ","), F.lit(""))), optional("|template=", F.col("template"))))
        .when(F.col("format") == "multiline", F.concat(F.lit("|stack="), F.col("_lines.stack").cast("string"), F.lit("|prefix="), F.col("_lines.prefix"), F.lit("|lines="), F.array_join("_lines.signs", "||")))
        .when(F.col("format").isin("plain_text", "unknown"), optional("|template=", F.col("template")))
        .otherwise(F.col("_nested.tail"))
    )
    canonical = F.concat(F.lit(f"{VERSION}:format="), F.col("format"), optional("|vendor=", F.col("vendor")), optional("|product=", F.col("product")), tail)
    done = step3.withColumn("canonical", canonical).withColumn("fingerprint", F.sha2("canonical", 256))
    made = ["format", "vendor", "product", "template", "canonical", "fingerprint"]
    if record:
        done, made = done.withColumn("features", built(feature_record)), [*made, "features"]
    # the user's columns travel as one, so that no name meets another; those named like a result are replaced
    return done.select(*(F.col("_row").getField(c).alias(c) for c in df.columns if c not in made), *made)
