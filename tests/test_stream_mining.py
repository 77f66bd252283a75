"""Drain, template memory and session buckets on a stream, over several micro-batches and restarts."""

import os
import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsift.operators.drain import drain, leaf_key
from logsift.operators.templates import grouping_buckets, template_memory, with_provenance, with_templates
from logsift.sinks.commits import Table
from logsift.streaming.mining import memory_sink, session_buckets, stream_drain

KIND = "log_id long, ts timestamp_ntz, tenant string, service string, message string"
START = datetime(2024, 1, 1)


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/part={n}")
    for f in os.listdir(f"{folder}/part={n}"):
        os.utime(f"{folder}/part={n}/{f}", (1_700_000_000 + 60 * n,) * 2)


def source(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(stream, name, checkpoint):
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    assert q.awaitTermination(90)


def batches():
    r, out, i = random.Random(8), [], 0
    for b in range(3):
        rows = []
        for s in range(120):
            words = ["user", r.choice(["ann", "bob", "eve"]), r.choice(["read", "wrote"]), f"file{i}", r.choice(["fast", "slow", "never"])][:r.choice([3, 5, 5])]
            rows.append((i, START + timedelta(seconds=120 * b + s), r.choice(["t", "t", None]), r.choice(["a", "b"]), " ".join(words)))
            i += 1
        rows.append((i, START + timedelta(seconds=120 * b + 119), "t", "a", " "))
        rows.append((i + 1, None, "t", "a", "user ann read late"))
        i += 2
        out.append(rows)
    return out


def plain_drain(rows, sim=0.4, most=1000):
    """The online miner over all records in order; the template at the time, and whether it matched."""
    leaves, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1] is None, r[1] or START, r[0])):
        toks = r[4].split()
        if not toks:
            continue
        leaf = leaves.setdefault((r[2], len(toks), *["<*>" if any(c.isdigit() for c in t) else t for t in toks[:2]]), OrderedDict())
        best = (-1.0, -1, None)
        for c, t in leaf.items():
            s, p = sum(a == b and a != "<*>" for a, b in zip(t, toks)) / len(t), t.count("<*>")
            if (s, p) > best[:2]:
                best = (s, p, c)
        if best[0] >= sim:
            c = best[2]
            leaf[c] = [a if a == b else "<*>" for a, b in zip(leaf[c], toks)]
            leaf.move_to_end(c)
        else:
            c = len([1 for k in leaf]) if not leaf else max(leaf) + 1
            leaf[c] = toks
            if len(leaf) > most:
                leaf.popitem(last=False)
        out[r[0]] = (" ".join(leaf[c]), best[0] >= sim)
    return out


@pytest.mark.parametrize("most", [1000, 2])
def test_stream_drain_is_the_online_miner(spark, tmp_path, most):
    src, parts = str(tmp_path / "in"), batches()
    parts = [[r for r in p if r[1] is not None] for p in parts]
    for n, rows in enumerate(parts):
        put(spark, src, n, rows)
    name = f"drain_{most}"
    run(stream_drain(source(spark, src), max_clusters=most, carry=("service",)), name, str(tmp_path / "ck"))
    got = spark.sql(f"SELECT * FROM {name}")
    rows = {r["log_id"]: r for r in got.collect()}
    want = plain_drain(sum(parts, []), most=most)
    assert {i: (r["template"], r["confidence"] > 0.6) for i, r in rows.items() if r["template"]} == want
    blank = [r for r in rows.values() if r["template"] is None]
    assert len(blank) == 3 and all(r["confidence"] == 0 for r in blank)
    assert {i: r["service"] for i, r in rows.items()} == {r[0]: r[3] for p in parts for r in p}


def test_stream_drain_equals_drain_online(spark, tmp_path):
    src = str(tmp_path / "in")
    words = ["user ann read x", "user bob read y", "user ann wrote x z", "user eve read w", "user ann wrote x y", "other thing entirely here", "user zed read y"]
    rows = [(i, START + timedelta(seconds=i), "t", "a", w) for i, w in enumerate(words)]
    for n in range(3):
        put(spark, src, n, rows[3 * n:3 * n + 3])
    run(stream_drain(source(spark, src)), "drain_online", str(tmp_path / "ck"))
    cols = ["log_id", "template", "template_id", "confidence"]
    batch = drain(spark.createDataFrame(rows, KIND), mode="online")
    assert sorted(map(tuple, spark.sql("SELECT * FROM drain_online").select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_memory_after_restarts_is_the_batch_memory(spark, tmp_path):
    src, parts = str(tmp_path / "in"), [[r for r in p if r[1] is not None] for p in batches()]
    sink = memory_sink(str(tmp_path / "memory"), str(tmp_path / "rows"))
    for n, rows in enumerate(parts):
        put(spark, src, n, rows)
        if n:  # two files in the first run, the third after a restart
            q = (with_templates(source(spark, src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck"))
                 .trigger(availableNow=True).start())
            assert q.awaitTermination(90)
    table = Table(spark, str(tmp_path / "memory"), ["template_id"])
    assert table.version().batches == {"memory": 2}
    sink(with_templates(spark.createDataFrame(parts[2], KIND)), 2)  # sent again
    whole = with_templates(spark.createDataFrame(sum(parts, []), KIND))
    cols = ["template_id", "template", "regex", "first_seen", "last_seen", "n", "examples"]
    assert sorted(map(str, table.read().select(cols).collect())) == sorted(map(str, template_memory(whole).select(cols).collect()))
    cols = ["log_id", "template_id", "provenance", "confidence"]
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "rows")).select(cols).collect())) == sorted(map(str, with_provenance(whole).select(cols).collect()))


def test_sessions_with_late_rows_are_the_batch_buckets(spark, tmp_path):
    src, r = str(tmp_path / "in"), random.Random(6)
    rows = []
    for i in range(240):
        minute = r.choice([0, 1, 3, 20, 21, 40, 44, 48, 90]) * 60 + r.randint(0, 59)
        rows.append((i, START + timedelta(seconds=minute, microseconds=r.randint(0, 999_999)), r.choice(["t", None]), "a", r.choice(["ping 1", "ping 2", "pong"])))
    rows.sort(key=lambda x: x[1])
    late = rows[60:70]  # these come with the next file, less than the watermark behind
    parts = [rows[:60] + rows[70:100], late + rows[100:200], rows[200:], [(999, START + timedelta(days=1), "t", "a", "closes all others")]]
    for n, p in enumerate(parts):
        put(spark, src, n, p)
    run(session_buckets(source(spark, src), watermark="60 minutes"), "sessions", str(tmp_path / "ck"))
    cols = ["tenant", "masked", "bucket", "size", "first_seen", "last_seen", "exemplars"]
    want = grouping_buckets(spark.createDataFrame(rows, KIND)).select(cols)
    assert sorted(map(str, spark.sql("SELECT * FROM sessions").select(cols).collect())) == sorted(map(str, want.collect()))
    assert want.where(F.col("tenant").isNull()).count() > 0


def test_leaf_keys_route_digits(spark):
    d = spark.createDataFrame([("a b1 c",), ("  a   b2 d ",)], "m string").select(leaf_key(F.col("m")).alias("k"))
    assert d.distinct().count() == 1
