import json

from pyspark.sql import functions as F

from logsift.operators.templates import align
from logsift.sources.payloads import flatten_push, read_json_batches


def test_push_strict_keys(spark):
    good = {"streams": [{"labels": '{service="api", env="prod"}',
                         "entries": [{"ts": "2024-01-01T00:00:00Z", "line": "hello"}]}]}
    bad = {"streams": [{"labels": '{service="api"}',
                        "entries": [{"timestamp": "2024-01-01T00:00:00Z", "line": "x"}]}]}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "value string")
    raw, rej = flatten_push(df)
    rows = raw.collect()
    assert [(r.payload, dict(r.labels)) for r in rows] == [("hello", {"service": "api", "env": "prod"})]
    assert [r.reason for r in rej.collect()] == ["bad_json"]


def test_json_batch_unknown_field_rejects_whole_batch(spark):
    ok = {"records": [{"timestamp": "2024-01-01T00:00:00", "labels": {"a": "1"}, "payload": "p1"}]}
    extra = {"records": [{"payload": "p2"}, {"payload": "p3", "level": "x"}]}
    df = spark.createDataFrame([(json.dumps(ok),), (json.dumps(extra),), ("not json",)], "value string")
    raw, rej = read_json_batches(df)
    assert [r.payload for r in raw.collect()] == ["p1"]
    assert sorted(r.reason for r in rej.collect()) == ["bad_body", "bad_json"]


def test_align_fallback_and_last_duplicate(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "log_id long, message string")
    right = spark.createDataFrame([(1, 1, "t1"), (1, 2, "t1b"), (2, 1, "t2"), (9, 1, "tx")],
                                  "log_id long, seq long, template_id string")
    out = {r.log_id: r.template_id for r in align(left, right, fallback={"template_id": "missing"}).collect()}
    assert out == {1: "t1b", 2: "t2", 3: "missing"}
