"""Ties, empty partitions, missing keys, odd sources, rule conditions, table versions."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logsift.operators import catalog as C
from logsift.operators import search as S
from logsift.operators.ordered import running_sum
from logsift.operators.sampling import Policy, decide, rule_condition, rules_policy
from logsift.operators.templates import merge_templates
from logsift.plans.logql import execute_plan
from logsift.sources.payloads import flatten_otlp, flatten_push, otlp_rejects, read_json_batches, route_protocol


def test_knn_equal_scores_are_ordered_by_id_over_partitions(spark):
    v = spark.range(200).select(F.format_string("%03d", "id").alias("id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding")).repartition(7)
    q = spark.createDataFrame([("q", [2.0, 4.0])], "query_id string, qvec array<double>")
    assert [r["id"] for r in S.knn(q, v, 5, "id").orderBy("rank").collect()] == ["000", "001", "002", "003", "004"]


def test_knn_without_any_hit_and_with_blocks(spark, monkeypatch):
    v = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")], "id string, embedding array<double>, tenant string").repartition(8)
    q = spark.createDataFrame([(f"q{i}", [1.0, float(i)], {"tenant": ["nobody" if i % 2 else "x"]}) for i in range(6)],
                              "query_id string, qvec array<double>, f map<string,array<string>>")
    monkeypatch.setattr(S, "BLOCK_BYTES", 32)
    got = S.knn(q, v, 3, "id", filter_cols=("tenant",), query_filters="f").collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [("q0", "a"), ("q2", "a"), ("q4", "a")]
    assert S.knn(q.limit(0), v, 3, "id").count() == 0


def test_merge_follows_long_chains(spark):
    words = [["a"] * 30]
    for i in range(29):
        words.append(words[-1][:i] + ["b"] + words[-1][i + 1:])
    rows = [("t", f"{i:03d}", " ".join(w)) for i, w in enumerate(words)] + [("t", "900", "other text"), (None, "901", "x y"), (None, "902", "x z")]
    got = {r["template_id"]: r["canonical_id"] for r in merge_templates(spark.createDataFrame(rows, "tenant string, template_id string, template string")).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(30)}, "900": "900", "901": "901", "902": "901"}


def test_rows_without_time_or_severity_are_decided(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, "INFO"), (2, None, "INFO"), (3, t, None)]
    d = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, severity string").withColumns(
        {c: F.lit("x") for c in ("tenant", "service", "env", "template_id")})
    got = {r["log_id"]: (r["action"], r["keep_reason"], r["policy_version"], r["seq"]) for r in decide(d).collect()}
    assert got[2] == ("KEEP", "WARMUP", "fallback", None) and got[1][3] == 1 and got[3][:2] == ("KEEP", "NOVEL")
    sums = running_sum(d.select("log_id", "ts", "severity"), ["severity"], None, "n").collect()
    assert len(sums) == 3 and len(rows) == decide(d, Policy(warmup_n=0)).count()


def test_rule_conditions_reach_columns_only(spark):
    def one(column, op, *values):
        return {"column": column, "op": op, "values": list(values)}
    for bad in ({}, {"column": "n"}, one("n", "like", "x"), one("n", "="), one("n", "=", 1, 2), one("n", "null", 1), {"column": F.col("n"), "op": "null"},
                {"any": [], "none": []}, {"expr": "reflect('a', 'b')"}):
        with pytest.raises(ValueError):
            rule_condition([bad])
    d = spark.createDataFrame([(1, "INFO", 5), (2, "WARN", None)], "log_id long, severity string, n int")
    hit = lambda *c: [r["log_id"] for r in d.filter(rule_condition(list(c))).orderBy("log_id").collect()]
    assert hit(one("severity", "in", "INFO", "WARN"), one("n", "not null")) == [1]
    assert hit({"none": [{"any": [[one("n", ">=", 3)], [one("severity", "=", "x")]]}]}) == []
    assert hit({"any": [[one("n", "null")], [one("n", ">", 4.5)]]}) == [1, 2] and hit(one("severity", "!=", "INFO")) == [2] and hit() == [1, 2]
    assert hit(one("severity", "not in", "INFO")) == [2] and hit(one("n", "<", 6), one("n", "<=", 5)) == [1]
    rules = [{"tests": [one("n", "=", 5)], "action": "KEEP"}]
    assert [r["a"] for r in d.select(rules_policy(rules).alias("a"), "log_id").orderBy("log_id").collect()] == ["KEEP", None]


def test_times_with_offsets_and_no_times(spark):
    now = F.lit("2024-05-05 00:00:00")
    recs = [{"timestamp": s, "labels": {}, "payload": s or "none"} for s in ("2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00Z", "2023-12-31T18:30:00.5-05:30", "soon", None)]
    raw, rej = read_json_batches(spark.createDataFrame([(json.dumps({"records": recs}),)], "value string"), now=now)
    got = {r["payload"]: r["ts"] for r in raw.collect()}
    assert rej.count() == 0 and got["2024-01-01T02:00:00+02:00"] == got["2024-01-01T00:00:00Z"] == dt.datetime(2024, 1, 1)
    assert got["2023-12-31T18:30:00.5-05:30"] == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)
    assert got["soon"] == got["none"] == dt.datetime(2024, 5, 5)
    push = {"streams": [{"labels": '{a="b"}', "entries": [{"ts": "2024-01-01T00:00:00-01:00", "line": "x"}]}]}
    assert flatten_push(spark.createDataFrame([(json.dumps(push),)], "value string"))[0].first()["ts"] == dt.datetime(2024, 1, 1, 1)


def test_otlp_loses_no_record_silently(spark):
    attr = lambda k, v: {"key": k, "value": {"stringValue": v}}
    doc = {"resourceLogs": [{"resource": {"attributes": [attr("a", "1"), attr("b", "x"), attr("a", "2")]}, "scopeLogs": [{"logRecords": [
        {"body": {"stringValue": "hello"}}, {"timeUnixNano": "1704067200000000000", "body": {"stringValue": "timed"}}]}]}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{broken",), (None,), ("{}",)], "value string")
    rows = {r["payload"]: r for r in flatten_otlp(df, now=F.lit("2024-05-05 00:00:00")).collect()}
    assert rows["hello"]["labels"] == {"a": "2", "b": "x"} and rows["hello"]["ts"] == dt.datetime(2024, 5, 5)
    assert rows["timed"]["ts"] == dt.datetime(2024, 1, 1)
    assert sorted(r["reason"] for r in otlp_rejects(df).collect()) == ["bad_body"] * 3
    kinds = spark.createDataFrame([("application/octet-stream", "/x"), (None, "/loki/api"), (None, None)], "c string, p string")
    assert [r[0] for r in kinds.select(F.coalesce(route_protocol(F.col("c"), F.col("p")), F.lit("json"))).collect()] == ["otlp", "push", "json"]


def test_plan_without_a_label_matches_all_its_values(spark):
    logs = spark.createDataFrame([(1, "user 5 logged in", {"service": "a", "env": "dev"}), (2, "user 6 logged in", {"service": "a", "namespace": "n"}),
                                  (3, "user 7 logged in", {"service": "b"})], "log_id long, message string, labels map<string,string>").withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    text, rx = "user <num> logged in", r"user \d+ logged in"
    plans = spark.createDataFrame([("p1", text, rx, {"service": "a"}), ("p2", text, rx, {"service": "a", "env": "dev"}), ("p3", "user <num>", r"user \d", {}),
                                   ("p4", "user <num>", r"user \d", {"service": "b"})], "plan_id string, template_text string, regex string, labels map<string,string>")
    assert sorted((r["plan_id"], r["log_id"]) for r in execute_plan(logs, plans).collect()) == [
        ("p1", 1), ("p1", 2), ("p2", 1), ("p3", 1), ("p3", 2), ("p3", 3), ("p4", 3)]


def test_readers_see_whole_versions_during_a_write(spark, tmp_path):
    path = str(tmp_path / "stats")
    one = spark.createDataFrame([("t", "a", "24h", 1, dt.datetime(2024, 1, 1))], "tenant string, template_id string, window string, count long, updated_at timestamp_ntz")
    assert C.read_current(spark, path) is None
    C.upsert_stats(path, one)
    reader = C.read_current(spark, path)
    C.upsert_stats(path, one.withColumn("count", F.lit(5).cast("long")).withColumn("updated_at", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")))
    (tmp_path / "stats" / "data" / "later" / "__bucket=0").mkdir(parents=True)  # a write that has not ended
    assert reader.first()["count"] == 1 and C.read_current(spark, path).first()["count"] == 5


def test_cluster_session_needs_a_shared_folder():
    from logsift.session import ensure_checkpoint_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "file:///shared"
    assert ensure_checkpoint_dir(Session()) == "file:///shared"


def test_parallel_drain_merges_parts_and_keeps_null_contexts(spark):
    from logsift.operators.drain import drain_parallel
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows = [(i, dt.datetime(2024, 1, 1), None if i % 2 else "t", f"job started on host {words[i % 7]} by {words[(i * 3) % 7]} ok") for i in range(90)]
    rows += [(100, None, "t", "  "), (101, None, "t", "another kind of line")]
    d = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, tenant string, message string")
    got = {r["log_id"]: r["template"] for r in drain_parallel(d, part_rows=3).collect()}
    assert len(got) == 92 and got[100] is None and got[101] == "another kind of line"
    assert {got[i] for i in range(90)} == {"job started on host <*> by <*> ok"}


def test_parallel_drain_compares_all_parts_of_a_leaf(spark):
    from logsift.operators.drain import _similarity, drain_parallel
    name = lambda i, k: "".join("bcdfghjklm"[int(c)] for c in f"{i:03d}{k:02d}")
    rows = []
    for i in range(60):  # 30 pairs of 0.5 in one leaf, 0.2 to each other
        shared = " ".join(name(i % 30, k) for k in range(3))
        rows.append((i, dt.datetime(2024, 1, 1), "t", f"job run {shared} " + " ".join(name(100 + i, k) for k in range(5))))
    d = spark.createDataFrame(rows, "log_id long, ts timestamp_ntz, tenant string, message string")
    got = {r["log_id"]: r["template"] for r in drain_parallel(d, part_rows=4).collect()}
    assert all(got[i] == got[i + 30] for i in range(30)) and len(set(got.values())) == 30
    found = [t.split() for t in set(got.values())]
    assert all(_similarity(a, b)[0] < 0.4 for a in found for b in found if a is not b)
