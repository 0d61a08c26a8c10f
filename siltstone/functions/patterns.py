"""The patterns, word lists and layouts that define templates, value types, vendors and rules (RE2 syntax).

`java()` turns an RE2 pattern into one for Spark's regular expressions; DuckDB runs the RE2 form as it is.
"""

from __future__ import annotations

WORD = "[0-9A-Za-z_]"
#: White space, one by one: what trimming cuts and words are split at.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: RE2's ASCII word boundary spelled out, for texts with characters beyond ASCII.
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# The 26 template steps in order, (name, pattern, replacement with \1 for groups).
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
MAC = r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b|\b[0-9a-f]{4}\.[0-9a-f]{4}\.[0-9a-f]{4}\b"
EMAIL = r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b"
ISO8601 = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b"
APACHE_TS = r"\b\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}(?: [+-]\d{4})?\b"
SYSLOG_TS = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"
TIME_ONLY = r"\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b"
EPOCH_MS = r"\b1[4-9]\d{11,12}\b"
EPOCH_SEC = r"\b1[4-9]\d{8}(?:\.\d+)?\b"
DYNAMIC = r"(?i)\b[a-z]+[-_][0-9a-z]*\d[0-9a-z]*(?:[-_][0-9a-z]+)*\b|\b[0-9a-z]*\d[0-9a-z]*[-_][a-z]+[-_][0-9a-z]+\b"
IPV6 = (
    r"(?i)\b(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,7}:|\b:(?::[0-9a-f]{1,4}){1,7}\b|"
    r"\b(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}\b|\b(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}\b|"
    r"\b(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}\b|\b(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}\b|"
    r"\b(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}\b|\b[0-9a-f]{1,4}:(?:(?::[0-9a-f]{1,4}){1,6})\b"
)
STEPS: list[tuple[str, str, str]] = [
    ("web_user", r"\s-\s+[^\s\[]+\s+\[", " - <USER> ["),
    ("user_agent", r"""(?i)"(?:Mozilla/\d+\.\d+|curl/\S+|Postman\S+|Wget/\S+|python-requests/\S+|Go-http-client/\S+)[^"]*\"""", '"<USER_AGENT>"'),
    ("ssh_key", r"(?i)\b(SHA256|MD5|RSA):[A-Za-z0-9+/=_-]+", r"\1:<HASH>"),
    ("user_context", r"(?i)\b(for\s+invalid\s+user|for\s+user|user(?:name)?)\s+([a-zA-Z0-9_.-]+)", r"\1 <USER>"),
    ("host_context", r"(?i)\b(from\s+host|host(?:name)?)\s+([a-zA-Z0-9_.-]+)", r"\1 <HOST>"),
    ("port_context", r"(?i)\b(port)\s+(\d+)", "port <PORT>"),
    ("url", r"""(?i)\b(?:https?|ftp|file)://[^\s"'<>]+""", "<URL>"),
    ("email", EMAIL, "<EMAIL>"),
    ("iso8601", ISO8601, "<TIMESTAMP>"),
    ("apache_ts", APACHE_TS, "<TIMESTAMP>"),
    ("syslog_ts", SYSLOG_TS, "<TIMESTAMP>"),
    ("date_only", r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", "<DATE>"),
    ("uuid", UUID, "<UUID>"),
    ("mac", MAC, "<MAC>"),
    ("sha256", r"\b[0-9a-fA-F]{64}\b", "<HASH>"),
    ("sha1", r"\b[0-9a-fA-F]{40}\b", "<HASH>"),
    ("md5", r"\b[0-9a-fA-F]{32}\b", "<HASH>"),
    ("hex_addr", r"\b0x[0-9a-fA-F]+\b", "<HEX_ADDR>"),
    ("mongo_id", r"\b[0-9a-fA-F]{24}\b", "<HEX_ID>"),
    ("ipv4_port", r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})[/:](\d{1,5})\b", "<IPV4>:<PORT>"),
    ("ipv4", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?:/\d{1,2})?\b", "<IPV4>"),
    ("ipv6", IPV6, "<IPV6>"),
    ("time_only", TIME_ONLY, "<TIME>"),
    ("epoch_ms", EPOCH_MS, "<TIMESTAMP>"),
    ("epoch_sec", EPOCH_SEC, "<TIMESTAMP>"),
    ("dynamic", DYNAMIC, "<DYNAMIC_ID>"),
]

# Vendor rules in order, (pattern or None, literals that also count, vendor, product).
VENDORS: list[tuple[str | None, tuple[str, ...], str, str]] = [
    (r"%(?:ASA|FTD|PIX)-\d-\d{6}", (), "cisco", "asa"),
    (r"%(?:SYS|LINK|LINEPROTO|SEC|IP)-\d-[A-Z0-9_]+", (), "cisco", "ios"),
    (r"(?i)\b(?:devid=FG|devname=FG|device_id=FG|type=(?:traffic|utm|event|virus|webfilter|ips)\b.*devname=)", (r'(?i)devid="fg', r'(?i)devname="fg'), "fortinet", "fortigate"),
    (r"\b(?:TRAFFIC|THREAT|CONFIG|SYSTEM|CORRELATION),(?:drop|allow|deny|alert|reset)", ("PAN-OS",), "palo_alto", "pan_os"),
    (r"\b(?:RT_FLOW|RT_IDP|RT_UTM|RT_IPSEC|SSG|JUNOS)\b", (), "juniper", "junos"),
    (r"(?i)\b(?:CheckPoint|SmartDefense|fw_log)\b", (), "checkpoint", "firewall1"),
    (r'(?i)xmlns="http://schemas\.microsoft\.com/win/2004/08/events/event"|<EventID>\d+</EventID>|Microsoft-Windows-', (), "microsoft", "windows_event"),
]
AWS = r"\b(?:\d+ eni-[0-9a-f]+ \d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|aws:cloudtrail|aws_region)\b"
AZURE = r"(?i)\b(?:AzureActivity|AzureDiagnostics|/SUBSCRIPTIONS/[0-9a-fA-F\-]+)\b"
LINUX = r"\b(?:sshd|systemd|kernel|sudo|cron|auditd|dockerd|containerd)\[\d+\]:"
LINUX_PRODUCTS = ["sshd", "systemd", "sudo", "cron", "auditd"]

# Numbers kept in templates, by key.
SMALL_ENUMS = [
    (["version", "v", "ver"], [(0, 10)]),
    (["severity", "sev", "pri", "facility", "fac", "level"], [(0, 24)]),
    (["status", "http_status", "code", "response_code", "status_code"], [(100, 599), (0, 10)]),
    (["proto", "protocol"], [(1, 1), (6, 6), (17, 17), (47, 47), (50, 50), (58, 58)]),
]
ENUM_KEYS = [
    *("action", "act", "status", "level", "severity", "sev", "pri", "priority", "proto", "protocol", "method", "http_method"),
    *("type", "event_type", "version", "v", "ver", "op", "operation", "result", "disposition", "category", "cat", "facility"),
    *("fac", "state", "direction", "dir"),
]

# Syslog headers and stack trace marks.
RFC5424 = r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)"
RFC3164 = r"^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\s\[]+)(?:\[(\d+)\])?:\s*(.*)"
BSD = r"^([A-Za-z]{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\s\[]+)(?:\[(\d+)\])?:\s*(.*)"
STACK = [
    r"(?m)^\s+at\s+([a-zA-Z0-9_$.]+)\(",
    r"(?m)^Caused by:\s+([a-zA-Z0-9_$.]+)",
    r'(?m)^\s+File\s+"[^"]+",\s+line\s+\d+',
    r"(?m)^Traceback \(most recent call last\):",
    r"(?m)^goroutine \d+ \[[^\]]+\]:",
]

# The default rules, (name, pattern, datetime layout or None, has transformations), first match wins.
DEFAULT_RULES: list[tuple[str, str, str | None, bool]] = [
    ("Generic Structured Log Parser", r"^(?P<timestamp>\S+ \S+) (?P<severity>[A-Za-z]+) (?P<service>\S+) (?P<host>\S+) (?P<message>.*)$", "2006-01-02 15:04:05", True),
    ("Bracketed Service Log Parser", r"^(?P<timestamp>\S+) \[(?P<severity>[A-Za-z]+)\] \[(?P<service>\S+)\] (?P<message>.*)$", "", True),
    ("Timestamp Severity Log Parser", r"^(?P<timestamp>\S+ \S+) (?P<severity>[A-Za-z]+) (?P<message>.*)$", "2006-01-02 15:04:05", True),
    ("", r"^(?P<message>.*)$", None, False),
]

# Fixed value: the decimal, hexadecimal and named floating-point forms that count as numbers.
NUMBER = r"(?:[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)|[nN][aA][nN])"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
STRICT_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def strict_ipv6() -> str:
    """Every way to write eight groups, one run of zero groups elided, the last two possibly as IPv4."""
    g = "[0-9a-fA-F]{1,4}"
    ways = [f"(?:{g}:){{7}}{g}", f"(?:{g}:){{6}}{STRICT_IPV4}"]
    for before in range(8):
        head = f"{g}(?::{g}){{{before - 1}}}" if before else ""
        room = 7 - before
        tail = f"(?:{g}(?::{g}){{0,{room - 1}}})?" if room else ""
        ways.append(f"{head}::{tail}")
        if room >= 2:
            ways.append(f"{head}::(?:{g}:){{0,{room - 2}}}{STRICT_IPV4}")
    return "(?:" + "|".join(ways) + ")"


def java(pattern: str, ascii_only: bool = True) -> str:
    """An RE2 pattern for java.util.regex: `.` stops at \\n alone, \\s has no vertical tab, $ is the very end."""
    p = pattern.replace(r"[^\s", "[^\\t\\n\\f\\r ").replace(r"[^:\s", "[^:\\t\\n\\f\\r ")
    p = p.replace(r"\S", "[^\\t\\n\\f\\r ]").replace(r"\s", "[\\t\\n\\f\\r ]")
    if p.endswith("$"):
        p = p[:-1] + r"\z"
    if not ascii_only:
        p = p.replace(r"\b", BOUNDARY)
    return "(?d)" + p
