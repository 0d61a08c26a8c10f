"""Templates and value types as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import patterns as P

SPACE = "[\\t-\\r \\x{85}\\p{Z}]"
MOST_BYTES = 4096


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(P.SPACES))


def built(make: Callable[..., Column], *names: str) -> Column:
    """make(columns of these names), built once for each Spark context: large expressions take a second to put together."""
    kept = SparkContext._active_spark_context.__dict__.setdefault("_siltstone_columns", {})
    key = (make.__module__, make.__qualname__, names)
    if key not in kept:
        kept[key] = make(*map(F.col, names))
    return kept[key]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def matches(c: Column, pattern: str) -> Column:
    """RE2's find. The look-around form of \\b is slower, so it serves only rows with characters beyond ASCII."""
    plain = c.rlike(P.java(pattern))
    return F.when(is_ascii(c), plain).otherwise(c.rlike(P.java(pattern, False))) if r"\b" in pattern else plain


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def step(c: Column, pattern: str, replacement: str, ascii_only: bool = True) -> Column:
    """One template step."""
    return F.regexp_replace(c, P.java(pattern, ascii_only), replacement.replace("\\1", "$1"))


def seen(c: Column) -> dict[str, Column]:
    """A text, its lower-case form and the character classes that the steps ask for, by name."""
    has = lambda x: F.contains(c, F.lit(x))
    return {
        "text": c,
        "low": F.lower(c),
        "size": F.octet_length(c),
        "ascii": is_ascii(c),
        "digit": c.rlike("[0-9]"),
        **{name: has(x) for name, x in [("dash", "-"), ("colon", ":"), ("slash", "/"), ("dot", "."), ("at", "@"), ("quote", '"'), ("bracket", "["), ("line", "_"), ("hex", "0x")]},
    }


def seen_in(c: Column) -> Column:
    """seen() as a struct, each part looked up once."""
    return F.struct(*(v.alias(k) for k, v in seen(c).items()))


def needs(s: Column | dict[str, Column]) -> dict[str, Column]:
    """By template step: whether a text (as seen shows it) has what the step's pattern cannot do without.

    Every replacement but its angle-bracketed name comes from the text itself, and no pattern reaches into such a name, so
    what the text lacks at first no earlier step brings in.
    """
    text, digit, dash, colon, slash, dot = (s[x] for x in ("text", "digit", "dash", "colon", "slash", "dot"))
    says = lambda x: F.contains(s["low"], F.lit(x))
    long_hex = (s["size"] >= 24) & text.rlike("[0-9a-fA-F]{24}")
    epoch = digit & (s["size"] >= 10) & text.rlike("1[4-9][0-9]{8}")
    return {
        "web_user": s["bracket"] & dash,
        "user_agent": s["quote"] & slash,
        "ssh_key": colon & (says("sha256:") | says("md5:") | says("rsa:")),
        "user_context": says("user"),
        "host_context": says("host"),
        "port_context": digit & says("port"),
        "url": colon & slash & F.contains(text, F.lit("://")),
        "email": s["at"],
        "iso8601": digit & dash & colon,
        "apache_ts": digit & slash & colon,
        "syslog_ts": digit & colon & text.rlike("[JFMASOND][a-z]{2}[\\t\\n\\f\\r ]"),
        "date_only": digit & (dash | slash),
        "uuid": digit & dash & (s["size"] >= 36),
        "mac": (s["size"] >= 14) & (colon | dash | dot) & text.rlike("(?:[:-][0-9a-fA-F]{2}){5}|[.][0-9a-fA-F]{4}[.]"),
        "sha256": (s["size"] >= 64) & long_hex,
        "sha1": (s["size"] >= 40) & long_hex,
        "md5": (s["size"] >= 32) & long_hex,
        "hex_addr": s["hex"],
        "mongo_id": long_hex,
        "ipv4_port": digit & dot & (colon | slash),
        "ipv4": digit & dot,
        "ipv6": colon & text.rlike("::|(?::[0-9a-fA-F]{1,4}){7}"),
        "time_only": digit & colon,
        "epoch_ms": epoch,
        "epoch_sec": epoch,
        "dynamic": digit & (dash | s["line"]) & text.rlike("[A-Za-z][-_]|[-_][A-Za-z]"),
    }


def lone_step(c: Column, name: str) -> Column:
    """One template step of a text, run only where the text has what it needs."""
    pattern, replacement = next(s[1:] for s in P.STEPS if s[0] == name)
    due, ascii_only = needs(seen(c))[name], is_ascii(c)
    return F.when(due & ascii_only, step(c, pattern, replacement)).when(due, step(c, pattern, replacement, False)).otherwise(c)


def steps(c: Column) -> Column:
    """All template steps in order. Only those run for which a text has what they need; with characters beyond ASCII the
    slower form of \\b serves."""

    return let(seen_in(c), lambda s: stepped(s["text"], due(s)))


def due(s: Column) -> Column:
    """Numbers of the steps to run on a text (as seen_in shows it); the second half are the forms beyond ASCII."""
    need = needs(s)
    shift = F.when(s["ascii"], 0).otherwise(len(P.STEPS))
    return F.array_remove(F.array(*(F.when(need[name], shift + k).otherwise(-1) for k, (name, _, _) in enumerate(P.STEPS))), -1)


def stepped(c: Column, numbers: Column) -> Column:
    """A text after the steps of these numbers."""
    many = len(P.STEPS)

    def apply(text: Column, at: Column) -> Column:
        forms = [(k + (0 if plain else many), step(text, pattern, replacement, plain)) for plain in (True, False) for k, (_, pattern, replacement) in enumerate(P.STEPS)]
        return reduce(lambda out, f: out.when(at == f[0], f[1]), forms[1:], F.when(at == forms[0][0], forms[0][1]))

    return F.reduce(numbers, c, apply)


def is_number(c: Column) -> Column:
    """The text parses as a finite float (or says inf or nan itself)."""
    value = c.try_cast("double")
    too_large = c.rlike("^[+-]?[0-9.]") & value.isNotNull() & (F.abs(value) == float("inf"))
    return c.rlike(f"^{P.NUMBER}\\z") & ~F.coalesce(too_large, F.lit(False))


def small_enum(value: Column, key: Column) -> Column:
    """A small number that means something under its (lower-case) key and stays in the template."""
    n = F.when(value.rlike("^[+-]?[0-9]+\\z"), value.try_cast("bigint"))
    ok = F.lit(False)
    for keys, spans in P.SMALL_ENUMS:
        inside = reduce(lambda a, b: a | b, (n.between(lo, hi) for lo, hi in spans))
        ok = ok | (key.isin(keys) & inside)
    return F.coalesce(ok, F.lit(False))


def fields(c: Column) -> Column:
    """Split on runs of white space, without empty pieces."""
    return F.filter(F.split(collapse_whitespace(c), " "), lambda x: x != "")  # a split at more than one character compiles its pattern each time


def number_token(tok: Column) -> Column:
    k = F.substring_index(tok, "=", 1)
    v = F.substr(tok, F.char_length(k) + 2)
    bare = F.regexp_replace(tok, r"[,.;:)\]}]+\z", "")
    tail = F.substr(tok, F.char_length(bare) + 1)
    return (
        F.when(F.contains(tok, F.lit("=")), F.when(small_enum(v, F.lower(k)), tok).when(is_number(v), F.concat(k, F.lit("=<NUMBER>"))).otherwise(tok))
        .when(is_number(tok), F.lit("<NUMBER>"))
        .when(is_number(bare), F.concat(F.lit("<NUMBER>"), tail))
        .otherwise(tok)
    )


#: How a number begins, at the start of a word or after its first `=`; most words are told apart by it.
_STARTS = "[+-]?(?:[.]?[0-9]|[iI][nN][fF]|[nN][aA][nN])"


def remaining_numbers(c: Column) -> Column:
    """Words joined by one space, numbers among them replaced; a text without the start of a number is not taken apart."""
    each = lambda tok: F.when(tok.rlike(f"^(?:[^=]*=)?{_STARTS}"), number_token(tok)).otherwise(tok)
    words = lambda x: F.array_join(F.transform(fields(x), each), " ")
    return let(c, lambda x: F.when(x.rlike(f"(?:^|{SPACE[:-1]}=]){_STARTS}"), words(x)).otherwise(collapse_whitespace(x)))


def collapse_whitespace(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, f"{SPACE}{{2,}}|{SPACE[:-1]}&&[^ ]]", " "))


def normalize_template(c: Column) -> Column:
    """Volatile values replaced by placeholders; texts above 4096 bytes are cut there and marked."""
    return finished(c, steps(first_bytes(c)))


def first_bytes(c: Column) -> Column:
    long = F.octet_length(c) > MOST_BYTES
    return F.when(long, F.make_valid_utf8(F.substring(c.cast("binary"), 1, MOST_BYTES).cast("string"))).otherwise(c)


def finished(c: Column, done: Column) -> Column:
    """The template of a text from what the steps left of its first bytes."""
    return F.concat(remaining_numbers(done), F.when(F.octet_length(c) > MOST_BYTES, " <TRUNCATED>").otherwise(""))


def detect_value_type(c: Column) -> Column:
    """The label of a value: the first rule that holds."""
    shown = lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), F.octet_length(t).alias("size"))
    return let(let(trim_space(c), shown), lambda s: _value_type(s["t"], s["low"], s["size"]))


def _value_type(t: Column, low: Column, size: Column) -> Column:
    rules: list[tuple[Column, str]] = [
        (t == "", "string"),
        (low.isin("true", "false", "yes", "no"), "bool"),
        (low.isin("null", "nil", "none"), "null"),
        ((size == 36) & matches(t, P.UUID), "uuid"),
        (size.isin(17, 14) & matches(t, P.MAC), "mac"),
        (F.contains(t, F.lit(".")) & t.rlike(f"^{P.STRICT_IPV4}\\z"), "ipv4"),
        (F.contains(t, F.lit(":")) & t.rlike(f"^{P.strict_ipv6()}\\z"), "ipv6"),
        (size.isin(64, 40, 32) & t.rlike("^[0-9a-fA-F]+\\z"), "hex_hash"),
        (low.startswith("http://") | low.startswith("https://") | low.startswith("ftp://"), "url"),
        (F.contains(t, F.lit("@")) & matches(t, P.EMAIL), "email"),
        (F.contains(t, F.lit(":")) & (matches(t, P.ISO8601) | matches(t, P.APACHE_TS) | matches(t, P.SYSLOG_TS)), "timestamp"),
        ((size <= 12) & F.contains(t, F.lit(":")) & matches(t, P.TIME_ONLY), "time"),
        ((size >= 10) & (matches(t, P.EPOCH_MS) | matches(t, P.EPOCH_SEC)), "timestamp"),
        (is_number(t), "number"),
    ]
    out: Column | None = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("string")


#: Literals of which a text has one at least where the vendor's rule can hold; those of the second kind in any case.
_VENDOR_MARKS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "asa": (("%",), ()),
    "ios": (("%",), ()),
    "fortigate": ((), ("devid=", "devname=", "device_id=")),
    "pan_os": (("TRAFFIC,", "THREAT,", "CONFIG,", "SYSTEM,", "CORRELATION,", "PAN-OS"), ()),
    "junos": (("RT_", "SSG", "JUNOS"), ()),
    "firewall1": ((), ("checkpoint", "smartdefense", "fw_log")),
    "windows_event": ((), ("schemas.microsoft.com", "<eventid>", "microsoft-windows-")),
    "aws": (("eni-", "aws:cloudtrail", "aws_region"), ()),
    "azure": ((), ("azureactivity", "azurediagnostics", "/subscriptions/")),
    "linux": (("]:",), ()),
}


def vendor_product(text: Column) -> Column:
    """struct<vendor, product>, both '' where no rule holds."""
    return let(F.struct(text.alias("text"), F.lower(text).alias("low")), lambda s: _vendor_product(s["text"], s["low"]))


def _vendor_product(c: Column, low: Column) -> Column:
    pair: Callable[[str, str], Column] = lambda v, p: F.struct(F.lit(v).alias("vendor"), F.lit(p).alias("product"))

    def maybe(name: str) -> Column:
        exact, folded = _VENDOR_MARKS[name]
        return reduce(lambda a, b: a | b, [*(F.contains(c, F.lit(x)) for x in exact), *(F.contains(low, F.lit(x)) for x in folded)])

    out: Column | None = None
    for pattern, also, vendor, product in P.VENDORS:
        cond = maybe(product) & reduce(lambda a, b: a | b, [matches(c, pattern), *(c.rlike(x) for x in also)])
        out = F.when(cond, pair(vendor, product)) if out is None else out.when(cond, pair(vendor, product))
    aws = maybe("aws") & matches(c, P.AWS)
    out = out.when(aws & F.contains(c, F.lit("eni-")), pair("aws", "vpc_flow")).when(aws, pair("aws", "cloudtrail"))
    out = out.when(maybe("azure") & matches(c, P.AZURE), pair("microsoft", "azure"))
    linux = maybe("linux") & matches(c, P.LINUX)
    for name in P.LINUX_PRODUCTS:
        out = out.when(linux & F.contains(c, F.lit(name)), pair("linux", name))
    return out.when(linux, pair("linux", "system")).otherwise(pair("", ""))


def normalize_value(key: Column, value: Column) -> Column:
    """A single value's placeholder; enum-like keys keep short identifiers."""
    return let(trim_space(value), lambda t: _normalize_value(F.lower(key), t))


def _normalize_value(k: Column, given: Column) -> Column:
    t = given
    quoted = (t.rlike('(?s)^".*"\\z') | t.rlike("(?s)^'.*'\\z")) & (F.octet_length(t) >= 2)
    t = F.when(quoted, F.substr(t, F.lit(2), F.char_length(t) - 2)).otherwise(t)
    return F.when(given == "", "").otherwise(let(let(t, lambda x: F.struct(x.alias("t"), detect_value_type(x).alias("kind"))), lambda s: _placeholder(k, s["t"], s["kind"])))


def _placeholder(k: Column, t: Column, kind: Column) -> Column:
    kept = k.isin(P.ENUM_KEYS) & (F.octet_length(t) <= 15) & t.rlike(r"^[\p{L}\p{Nd}_-]*\z")
    out = F.when(kept, F.lower(t))
    for label, mark in [("ipv4", "IPV4"), ("ipv6", "IPV6"), ("mac", "MAC"), ("uuid", "UUID"), ("timestamp", "TIMESTAMP"), ("time", "TIME"), ("hex_hash", "HASH"), ("url", "URL"), ("email", "EMAIL"), ("null", "NULL")]:
        out = out.when(kind == label, f"<{mark}>")
    out = out.when((kind == "number") & small_enum(t, k), t).when(kind == "number", "<NUMBER>").when(kind == "bool", F.lower(t))
    return out.when(matches(t, P.DYNAMIC), "<DYNAMIC_ID>").otherwise(normalize_template(t))


def structural_tokens(template: Column) -> Column:
    """Words of a template without brackets, colons, commas and quotes at their ends; words of those alone are left out."""
    bare = F.transform(F.split(template, " "), lambda w: F.btrim(w, F.lit("()[]{}:,\"'")))
    return F.filter(bare, lambda w: w != "")
