"""Sampler state on a stream: several micro-batches, gaps, restarts, timers and replays equal the batch answer."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logsift.operators.sampling import Policy, decide, ema_alpha
from logsift.streaming.sampler import KEY, MinuteCounts, SamplerCounters, deduplicated, stateful_decide

KIND = "log_id long, ts timestamp_ntz, tenant string, template_id string, service string, env string, severity string, extra map<string,string>"
SHOWN = ["seq", "cur_min", "count_10m", "count_1h", "count_24h", "key_first_seen", "action", "keep_reason", "sample_rate", "note", "policy_version"]


def batches():
    """Three batches in time order, the third 26 hours after the second; some records without a time or a severity."""
    r, start, out, i = random.Random(3), datetime(2024, 1, 1, 0, 0, 30), [], 0
    for hours in (0, 2, 30):
        rows = []
        for s in sorted(r.sample(range(7000), 150)):
            key = (r.choice(["a", None]), r.choice(["x", "x", "y"]), "svc", " ", r.choice(["INFO", "DEBUG", "ERROR", None]))
            ts = None if r.random() < 0.05 else start + timedelta(hours=hours, seconds=s, microseconds=r.choice([0, 123456]))
            rows.append((i, ts, *key, {"i": str(i)}))
            i += 1
        out.append(rows)
    return out


def write(spark, folder, rows, name, at):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    for f in os.listdir(f"{folder}/{name}"):
        os.utime(f"{folder}/{name}/{f}", (at, at))


def run(stream, name, checkpoint):
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    assert q.awaitTermination(90)


def shown(df):
    return {r["log_id"]: [r[c] for c in SHOWN] + [None if r["ema"] is None else round(r["ema"], 9)] for r in df.collect()}


POLICY = Policy(spike_factor=1.5, min_spike=2, warmup_n=4, budget_10m=3, novelty_hours=3.0, steady_k={"DEBUG": 5, "INFO": 7})


def test_stream_equals_batch_over_micro_batches_and_a_gap(spark, tmp_path):
    src = str(tmp_path / "in")
    parts = batches()
    for n, rows in enumerate(parts):
        write(spark, src, rows, f"part={n}", 1_700_000_000 + 60 * n)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    policies = spark.createDataFrame([("a", 2)], "key_tenant string, warmup_n bigint")
    run(stateful_decide(stream, POLICY, policies=policies, carry=("extra",)), "state_gap", str(tmp_path / "ck"))
    got = spark.sql("SELECT * FROM state_gap")
    want = decide(spark.createDataFrame(sum(parts, []), KIND), POLICY, policies=policies)
    assert shown(got) == shown(want) and got.count() == 450
    assert {r["log_id"]: r["extra"] for r in got.collect()} == {r[0]: r[7] for rows in parts for r in rows}
    # what the gap must not reset
    assert got.where("ts >= '2024-01-02 06:00:00' AND seq <= 2 AND key_first_seen < '2024-01-02'").count() == 0
    assert got.where("ts IS NULL").select("policy_version").distinct().collect()[0][0] == "fallback"


def test_state_survives_a_restart(spark, tmp_path):
    src, parts = str(tmp_path / "in"), batches()
    one = lambda n: write(spark, src, parts[n], f"part={n}", 1_700_000_000 + 60 * n)
    one(0)
    for n in (1, 2):
        one(n)
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
        out = stateful_decide(stream, POLICY).select("log_id", "ema", *SHOWN)
        q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
             .trigger(availableNow=True).start())
        assert q.awaitTermination(90)
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == shown(decide(spark.createDataFrame(sum(parts, []), KIND), POLICY))


def test_replayed_files_change_nothing(spark, tmp_path):
    src, parts = str(tmp_path / "in"), batches()
    for n, rows in enumerate([parts[0], parts[1], parts[1], parts[2], parts[2][:20] + parts[0][-3:]]):
        write(spark, src, rows, f"part={n}", 1_700_000_000 + 60 * n)
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    run(deduplicated(stream, "40 hours"), "deduplicated", str(tmp_path / "ck"))
    got = [r["log_id"] for r in spark.sql("SELECT log_id FROM deduplicated WHERE ts IS NOT NULL").collect()]
    assert sorted(got) == sorted(r[0] for rows in parts for r in rows if r[1] is not None)


@pytest.mark.parametrize("inclusive", [True, False])
def test_counters_are_the_sequential_ones(inclusive):
    r, alpha = random.Random(1), ema_alpha(10.0)
    minutes, total, ema, want = {}, 0, 0.0, []
    state = MinuteCounts(0, 0.0, None, {}, alpha, inclusive)
    got = []
    for start in (0, 100, 3000):
        us = np.sort(np.array([(start * 60 + r.randint(0, 2500)) * 1_000_000 for _ in range(80)]))
        out = state.count(us)
        got += list(zip(*(out[c].tolist() for c in ("seq", "cur_min", "count_10m", "count_1h", "count_24h")), [round(x, 9) for x in out["ema"]]))
        for t in us.tolist():
            m = t // 60_000_000
            minutes[m] = minutes.get(m, 0) + 1
            total += 1
            ema = alpha * minutes[m] + (1 - alpha) * ema
            spans = [sum(c for k, c in minutes.items() if m - n + (not inclusive) <= k <= m) for n in (10, 60, 1440)]
            want.append((total, minutes[m], *spans, round(ema, 9)))
    assert got == want


class FakeState:
    def __init__(self):
        self.value, self.map = None, {}

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    iterator = lambda self: iter(list(self.map.items()))
    updateValue = lambda self, k, v: self.map.__setitem__(k, v)
    removeKey = lambda self, k: self.map.pop(k)
    clear = lambda self: self.map.clear()


class FakeHandle:
    def __init__(self):
        self.timers, self.totals, self.minutes = set(), FakeState(), FakeState()

    getValueState = lambda self, *a: self.totals
    getMapState = lambda self, *a: self.minutes
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.remove(t)


def test_minutes_expire_and_totals_do_not():
    handle = FakeHandle()
    p = SamplerCounters(0.1, True, 1560, ["log_id", "ts_us", *KEY, "seq", "count_24h", "cur_min", "ema", "first_us"])
    p.init(handle)
    key = ("t", "x", "s", "e", "INFO")

    def feed(minutes, now):
        rows = pd.DataFrame({"log_id": range(len(minutes)), "ts_us": [m * 60_000_000 for m in minutes], "arrived_ms": now})
        return pd.concat(p.handleInputRows(key, iter([rows]), None))

    feed([0, 0, 1, 100], 1000)
    assert handle.minutes.map == {(0,): (2,), (1,): (1,), (100,): (1,)} and handle.timers == {1000 + 1560 * 60_000}
    out = feed([1600], 2000)  # minutes before 40 go, as the key is seen
    assert handle.minutes.map == {(100,): (1,), (1600,): (1,)} and handle.timers == {2000 + 1560 * 60_000}
    assert out["seq"].tolist() == [5] and out["first_us"].tolist() == [0]
    ema = handle.totals.value[1]
    list(p.handleExpiredTimer(key, None, None))
    assert handle.minutes.map == {} and handle.totals.value == (5, ema, 0, None)
    out = feed([9000], 3000)
    assert out["seq"].tolist() == [6] and out["count_24h"].tolist() == [1]


def test_read_back_of_nothing(spark):
    assert decide(spark.createDataFrame([], KIND)).where(F.col("seq").isNotNull()).count() == 0
