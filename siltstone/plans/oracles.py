"""DuckDB SQL pieces that state the same results as the Column expressions."""

from __future__ import annotations

from siltstone.functions import patterns as P
from siltstone.sources.corpus import duckdb_cte


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(x: str) -> str:
    for _, pattern, replacement in P.STEPS:
        x = f"regexp_replace({x}, {q(pattern)}, {q(replacement)}, 'g')"
    return x


def is_number(x: str) -> str:
    return f"regexp_full_match({x}, {q(P.NUMBER)})"


def small_enum(value: str, key: str) -> str:
    n = f"(CASE WHEN regexp_full_match({value}, '[+-]?[0-9]+') THEN try_cast({value} AS BIGINT) END)"
    rules = []
    for keys, spans in P.SMALL_ENUMS:
        inside = " OR ".join(f"{n} BETWEEN {lo} AND {hi}" for lo, hi in spans)
        rules.append(f"({key} IN ({', '.join(map(q, keys))}) AND ({inside}))")
    return f"coalesce({' OR '.join(rules)}, false)"


def numbers(x: str) -> str:
    k, v = "split_part(t, '=', 1)", "substr(t, strpos(t, '=') + 1)"
    bare = r"regexp_replace(t, '[,.;:)\]}]+$', '')"
    token = (
        f"CASE WHEN strpos(t, '=') > 0 THEN CASE WHEN {small_enum(v, f'lower({k})')} THEN t WHEN {is_number(v)} THEN {k} || '=<NUMBER>' ELSE t END "
        f"WHEN {is_number('t')} THEN '<NUMBER>' WHEN {is_number(bare)} THEN '<NUMBER>' || substr(t, length({bare}) + 1) ELSE t END"
    )
    return rf"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> ''), lambda t: {token}), ' ')"


def template(x: str) -> str:
    return numbers(fold(x))


def canonical() -> str:
    """Canonical form of each corpus shape: fixed for the nested ones, computed for those with templates."""
    msg = r"regexp_replace(raw_log, '^.*?\]:? ', '')"
    plain = template("raw_log")
    forms = [
        "'fp-v1:format=json|schema=object{event_type:string,props:object{k:number},timestamp:timestamp,user_id:number,value:number}'",
        "'fp-v1:format=key_value|fields=time:timestamp,type:string,user:number,value:number'",
        f"'fp-v1:format=syslog|ver=0|fac=' || (user_id % 24) || '|sev=3|app=app|msg_id=|template=' || {template(msg)}",
        "'fp-v1:format=cef|vendor=acme|product=shop|ver=0|dev_vendor=Acme|dev_product=Shop|dev_ver=1.0|class_id=' || event_type || '|sev=5|ext=cnt:number,src:ipv4'",
        "'fp-v1:format=csv|delim=,|cols=5|header=false|types=timestamp,ipv4,string,number,number'",
        f"'fp-v1:format=plain_text|template=' || {plain}",
        "'fp-v1:format=leef|vendor=acme|product=shop|ver=1.0|vendor=Acme|product=Shop|prod_ver=2|event_id=' || event_type || '|delim=' || chr(9) || '|ext=sev:number,src:ipv4'",
        f"'fp-v1:format=syslog|ver=1|fac=20|sev=5|app=app|msg_id=ID47|sd=ex@1.a,ex@1.b|template=' || {template(msg)}",
        f"'fp-v1:format=syslog|ver=0|fac=0|sev=0|app=app|msg_id=|template=' || {template(msg)}",
        "'fp-v1:format=xml|hierarchy=Event[id];Event/Type;Event/User;'",
        f"'fp-v1:format=multiline|stack=true|prefix=java_stack|lines=' || {template('split_part(raw_log, chr(10), 1)')} || '||at com.acme.Shop.run||Caused by: java.io.IOException: reset'",
        f"'fp-v1:format=plain_text|template=' || {plain}",
    ]
    return "CASE k " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"


FORMATS = ["json", "key_value", "syslog", "cef", "csv", "plain_text", "leef", "syslog", "syslog", "xml", "multiline", "plain_text"]


def with_marks() -> str:
    """CTEs corpus and marked: format, canonical and fingerprint."""
    fmt = "CASE k " + " ".join(f"WHEN {k} THEN {q(f)}" for k, f in enumerate(FORMATS)) + " END"
    return f"{duckdb_cte()}, canon AS (SELECT *, {fmt} AS format, {canonical()} AS canonical FROM corpus), marked AS (SELECT *, sha256(canonical) AS fingerprint FROM canon)"


def default_rule(x: str) -> str:
    """Name and pattern of the default rule of a log."""
    when = " ".join(f"WHEN regexp_matches({x}, {q(p)}) THEN {{'name': {q(n)}, 'pattern': {q(p)}}}" for n, p, _, _ in P.DEFAULT_RULES[:-1])
    return f"CASE {when} ELSE {{'name': '', 'pattern': {q(P.DEFAULT_RULES[-1][1])}}} END"


def with_rules() -> str:
    """CTEs to rules (one per fingerprint of the eligible requests, made from the smallest id) and done (the outcome)."""
    ok = "(NOT contains(d.raw_log, chr(10)) AND (r.rule.name = '' OR try_strptime(regexp_extract(d.raw_log, '^(\\S+ \\S+) ', 1), '%Y-%m-%d %H:%M:%S') IS NOT NULL))"
    return (
        f"{with_marks()}, taken AS (SELECT * FROM marked WHERE status = 'pending' AND attempts < 3), "
        f"rules AS (SELECT fingerprint AS hash, {default_rule('arg_min(raw_log, id)')} AS rule, arg_min(format, id) AS format, count(*) AS waiting FROM taken GROUP BY fingerprint), "
        f"done AS (SELECT d.*, r.rule.name AS rule_name, CASE WHEN {ok} THEN 'completed' ELSE 'failed' END AS result FROM taken d JOIN rules r ON d.fingerprint = r.hash)"
    )
