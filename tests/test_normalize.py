from pyspark.sql import functions as F

from logsift.functions.text import canonical_ws, detect_schema, parse_label_string, truncate_bytes


def test_schema_classification(spark):
    cases = [('   {"a":1}', "JSON"), ("{broken k=v", "TEXT"), ("level=info msg=x", "LOGFMT"),
             ("a == b", "TEXT"), ("plain words", "TEXT")]
    df = spark.createDataFrame(cases, "p string, want string")
    for r in df.select("want", detect_schema(F.col("p")).alias("got")).collect():
        assert r.got == r.want


def test_whitespace_and_truncation(spark):
    r = spark.createDataFrame([("  a \t\n b  ", "abcdef", "aé")], "a string, b string, c string").select(
        canonical_ws(F.col("a")).alias("a"), truncate_bytes(F.col("b"), 5).alias("b"),
        truncate_bytes(F.col("c"), 2).alias("c")).first()
    assert r.a == "a b" and r.b == "abcde" and r.c == "a"


def test_label_string_parse(spark):
    cases = ['{foo="bar2"}', '{a="1", b="2"}', "{}", "", '{a, b="2"}', '{a="1", a="3"}']
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [dict(r.m) for r in df.select(parse_label_string(F.col("s")).alias("m")).collect()]
    assert got == [{"foo": "bar2"}, {"a": "1", "b": "2"}, {}, {}, {"b": "2"}, {"a": "3"}]
