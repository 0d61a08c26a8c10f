import pytest
from siltstone.functions.layouts import from_tokens, to_rfc3339
from siltstone.operators.parse import ParseError, parse_one, transform
from siltstone.operators.rules import valid

CASES = [
    ("upper", "", "straße", "STRAßE"),
    ("LOWERCASE", "", "Ω-Mega", "ω-mega"),
    ("trim_space", "", "\t left\n", "left"),
    ("int", "", " -0007 ", "-7"),
    ("number", "", "1e20", "100000000000000000000"),
    ("decimal", "", "0x1p-2", "0.25"),
    ("date", "2006-01-02", "2031-02-03", "2031-02-03T00:00:00Z"),
    ("time", "YYYY-MM-DD HH:mm", "2031-02-03 04:05", "2031-02-03T04:05:00Z"),
    ("timestamp", "", "2031-02-03T04:05:06+01:30", "2031-02-03T02:35:06Z"),
    ("unix", "", "0", "1970-01-01T00:00:00Z"),
    ("epoch_milli", "", "-1", "1969-12-31T23:59:59Z"),
]


@pytest.mark.parametrize(("kind", "layout", "value", "want"), CASES)
def test_transformations(kind, layout, value, want):
    assert transform(value, kind, layout) == want


@pytest.mark.parametrize(("kind", "layout", "value"), [("datetime", "2006-01-02", "03.02.2031"), ("reverse", "", "abc"), ("int", "", "7.0"), ("number", "", "1e400"), ("date", "", "2031-02-30"), ("epoch_s", "", "9" * 18)])
def test_failures(kind, layout, value):
    with pytest.raises(ParseError):
        transform(value, kind, layout)


def test_layouts():
    assert from_tokens("YYYY-MM-DD HH:mm:ss.SSS") == "2006-01-02 15:04:05.05S"
    assert to_rfc3339("Feb 03 04:05:06", "") == "0000-02-03T04:05:06Z"
    assert to_rfc3339("2031-02-03 04:05:06.25", "2006-01-02 15:04:05") == "2031-02-03T04:05:06Z"
    assert to_rfc3339("2031-02-03T01:05:06+02:00", "") == "2031-02-02T23:05:06Z"


def test_matching():
    assert parse_one("ab", "a|ab", {}, {})[1] == "partial match"
    assert parse_one("x\n", r"^(?P<message>.*)$", {}, {})[1] == "no match"
    out, err = parse_one("a", r"(?P<x_1>a)(?<y>b)?", {}, {})
    assert err is None and out["metadata"] == {"x_1": "a", "y": ""}
    assert parse_one("a", "(?P<x>a)", {"z": "message"}, {})[1] == "field 'z' is not captured"
    assert parse_one("a", "", {}, {})[1] == "empty pattern" and "invalid" in parse_one("a", "(?=a)a", {}, {})[1]
    out, _ = parse_one("E m", r"(?P<s>\w) (?P<m>\w)", {"s": "severity", "m": "metadata.k"}, {"severity": {"type": "lower", "format": ""}})
    assert (out["severity"], out["metadata"]) == ("e", {"k": "m"})
    assert valid("(?<a>x)") and not valid("(a)\\1") and not valid("(")


def test_early_years_and_separators_of_old():
    assert transform("-62135596800", "unix", "") == "0001-01-01T00:00:00Z"
    assert transform(" \x1cx\t", "trim", "") == "\x1cx"
