"""Redaction goldens (code profile), Luhn cases and fold semantics."""
import pytest
from pyspark.sql import functions as F

from logsift.functions.redact import default_rules, luhn_ok, redact

CASES = [
    ("User connected from 192.168.1.1", "User connected from <ipv4>", ["ipv4"]),
    ("Contact user@example.com for support", "Contact <email> for support", ["email"]),
    # v1-style UUID: the v4-only pattern leaves it; its 12-digit tail is a phone number.
    ("Session ID: 123e4567-e89b-12d3-a456-426614174000", "Session ID: 123e4567-e89b-12d3-a456-<phone>", ["phone"]),
    ("Payment with card 4111-1111-1111-1111", "Payment with card <cc>", ["cc"]),
    ("Call +1-555-123-4567 for support", "Call +1-<phone>-<phone>-<phone> for support", ["phone"]),
    ("Visit https://example.com for more info", "Visit <url> for more info", ["url"]),
    ("User john@example.com from 192.168.1.1 visited https://example.com",
     "User <email> from <ipv4> visited <url>", ["ipv4", "email", "url"]),
    ("This is a normal log message", "This is a normal log message", []),
    ("12 123 x", "<phone> <phone>3 x", ["phone"]),
    ("ä12", "ä<phone>", ["phone"]),
]


def _run(spark, texts, profile="code"):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return df.select("t", redact(F.col("t"), default_rules(profile)).alias("r")).collect()


def test_goldens(spark):
    rows = _run(spark, [c[0] for c in CASES])
    got = {r.t: r.r for r in rows}
    for text, expected, rules in CASES:
        r = got[text]
        assert r.text == expected, text
        assert list(r.rules) == rules, text
        assert r.applied == bool(rules)


def test_intended_profile(spark):
    rows = _run(spark, ["Session ID: 123e4567-e89b-12d3-a456-426614174000", "Call +1-555-123-4567 for support"],
                "intended")
    got = {r.t: r.r.text for r in rows}
    assert got["Session ID: 123e4567-e89b-12d3-a456-426614174000"] == "Session ID: <uuid>"
    assert got["Call +1-555-123-4567 for support"] == "Call <phone> for support"


def test_count_includes_duplicates(spark):
    r = _run(spark, ["a 10.0.0.1 b 10.0.0.1"])[0].r
    assert r.text == "a <ipv4> b <ipv4>" and r["count"] == 2


@pytest.mark.parametrize("num,ok", [("4111111111111111", True), ("5555555555554444", True),
                                    ("378282246310005", True), ("1234567890123456", False),
                                    ("4111111111111112", False), ("", False), ("abc", False)])
def test_luhn(spark, num, ok):
    v = spark.createDataFrame([(num,)], "n string").select(luhn_ok(F.col("n")).alias("v")).first().v
    assert bool(v) == ok


def test_batch_of_three(spark):
    rows = _run(spark, ["ip 10.1.2.3", "mail a@b.co", "clean line"])
    assert [r.r.applied for r in rows] == [True, True, False]
