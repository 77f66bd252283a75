"""Counters of the sampler: one rollup of one pass over the rows, and the average that enters a minute as a stream."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from logsift.operators import metrics as MX
from logsift.operators.sampling import Enforcement, Policy, decide, ema_alpha, enforce, entering_average, route, with_counters, with_key

ROWS = "log_id long, ts timestamp_ntz, tenant string, template_id string, service string, env string, severity string, message string"
T0 = datetime(2024, 1, 1)


def _rows(n=400, seed=3):
    """Rows of few keys, some with null parts; times repeat, and some are null."""
    r = random.Random(seed)
    return [(i, None if r.random() < 0.03 else T0 + timedelta(seconds=r.randrange(900) * (1 if i % 2 else 40), microseconds=r.randrange(3)),
             r.choice(["a", None, " "]), r.choice(["x", None]), "s", "e", r.choice(["DEBUG", None]), "é" * r.randrange(4)) for i in range(n)]


def test_counters_of_null_keys_match_a_walk(spark):
    rows = _rows()
    got = {r.log_id: r for r in with_counters(with_key(spark.createDataFrame(rows, ROWS).repartition(5))).collect()}
    assert len(got) == len(rows)
    a, keys = ema_alpha(Policy().half_life), {}
    for row in sorted((x for x in rows if x[1]), key=lambda x: (x[1], x[0])):
        keys.setdefault(((row[2] or "").strip() or "default", row[3], row[6]), []).append(row)
    for own in keys.values():
        e, cur, minutes = 0.0, 0, [int((x[1] - T0).total_seconds() // 60) for x in own]
        for i, row in enumerate(own):
            cur = cur + 1 if i and minutes[i] == minutes[i - 1] else 1
            e = a * cur + (1 - a) * e
            g = got[row[0]]
            assert (g.seq, g.cur_min, g.key_first_seen) == (i + 1, cur, own[0][1])
            assert abs(g.ema - e) < 1e-9
            for span, name in ((10, "count_10m"), (60, "count_1h"), (1440, "count_24h")):
                assert g[name] == sum(minutes[i] - span <= m for m in minutes[:i + 1])
    assert all(got[x[0]].seq is None and got[x[0]].ema is None for x in rows if x[1] is None)


def test_average_goes_on_over_batches():
    r, seconds = random.Random(9), []
    for _ in range(6):
        total, minute = 0, 0
        for _ in range(r.randrange(1, 9)):
            minute, upto = minute + r.randrange(1, 4), total
            for _ in range(r.randrange(1, 4)):
                seconds.append((total, upto, minute))
                total += r.randrange(1, 5)
    names = ["__before", "__before_minute", "cur_minute"]

    def run(size):
        cuts = [seconds[i:i + size] for i in range(0, len(seconds), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*cut)], names) for cut in cuts]
        empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names)
        return np.concatenate([b.column("e0").to_numpy() for b in entering_average(0.2)(iter([empty, *batches[:1], empty, *batches[1:]]))])

    whole = run(len(seconds))
    assert all(np.array_equal(run(size), whole) for size in (1, 2, 7))
    assert all(e == 0 for (before, upto, _), e in zip(seconds, whole) if before == 0 or upto == 0)
    assert (whole > 0).any()


def test_rows_are_read_for_one_rollup_and_not_broadcast(spark):
    df = decide(spark.createDataFrame(_rows(), ROWS).withColumn("size", F.octet_length("message")).drop("message"))
    _, sup = route(enforce(df))
    plan = MX.suppressed_rollup(sup, "1 day", F.col("size"))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert plan.count("InMemoryTableScan [") == 2  # the rows, and the one rollup of them


def test_suppressed_bytes_are_those_of_the_message(spark):
    rows = spark.createDataFrame(_rows(), ROWS).withColumnsRenamed({"tenant": "key_tenant", "service": "key_service", "env": "key_env"})
    sized = rows.withColumn("size", F.octet_length("message"))
    assert sorted(map(str, MX.suppressed_rollup(rows, "1 day").collect())) == \
        sorted(map(str, MX.suppressed_rollup(sized, "1 day", F.col("size")).collect()))


def test_labels_are_read_for_namespaces_only(spark):
    rows = spark.createDataFrame([(1, "INFO", {"namespace": "n"}), (2, "INFO", {}), (3, "DEBUG", None)], "log_id long, severity string, labels map<string,string>")
    by = enforce(rows, Enforcement(by_namespace={"n": True}))
    assert [r.enforced for r in by.orderBy("log_id").collect()] == [True, False, True]
    assert [r.enforced for r in enforce(rows.drop("labels")).orderBy("log_id").collect()] == [False, False, True]
