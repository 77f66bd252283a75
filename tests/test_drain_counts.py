"""Drain with rows counted per cluster: the same clusters as with a row each, on little disk."""
import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

KIND = "log_id long, ts timestamp_ntz, tenant string, message string"


def _rows():
    r, out = random.Random(3), []
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "a1", "17"]
    for i in range(60):
        text = "job run " + " ".join(r.choice(words) for _ in range(4))
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(40))
        out.append((None if i % 23 == 0 else i, None if i % 17 == 0 else at, r.choice(["t", "u", None]), text))
    apart = lambda i, k: "".join("bcdfghjklm"[int(c)] for c in f"{i:02d}{k:02d}")
    out += [(300 + i, dt.datetime(2024, 1, 2), "t", "far apart " + " ".join(apart(i, k) for k in range(5))) for i in range(12)]
    out += [(400 + i, dt.datetime(2024, 1, 3), "t", "one hot line") for i in range(60)]
    return out + [(500, dt.datetime(2024, 1, 3), "t", None), (501, None, None, "  "), (502, None, None, "")]


@pytest.mark.parametrize("part_rows", [2000, 8])
def test_counted_clusters_are_those_of_the_rows(spark, part_rows):
    from logsift.operators.drain import drain_parallel
    d = spark.createDataFrame(_rows(), KIND)
    group = ["tenant", "template", "template_id", "regex", "drain_cluster"]
    want = sorted(map(repr, drain_parallel(d, part_rows=part_rows).groupBy(*group).agg(F.count(F.lit(1)).alias("lines")).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go over several batches
    try:
        got = drain_parallel(d, part_rows=part_rows, count_as="lines").groupBy(*group).agg(F.sum("lines").alias("lines")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(repr, got)) == want and sum(r.lines for r in got) == len(_rows())
    assert {r.tenant: r.lines for r in got if r.template is None} == {"t": 1, None: 2}


def _bytes(places) -> int:
    total = 0
    for d, _, names in (x for p in places for x in os.walk(p)):
        for n in names:
            try:
                total += os.path.getsize(os.path.join(d, n))
            except OSError:  # it may go meanwhile
                pass
    return total


def test_drain_of_documents_takes_little_disk(spark, tmp_path):
    from logsift import registry as R
    from logsift.session import ensure_checkpoint_dir
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(4000)]
    line = lambda: " ".join(r.choice(words) for _ in range(r.randrange(30, 60)))
    docs = [(i, "\n".join(line() for _ in range(40)), "en", f"s{i % 3}") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    places = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()] + [ensure_checkpoint_dir(spark).removeprefix("file:")]
    start, peak, over = _bytes(places), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            peak[0] = max(peak[0], _bytes(places) - start)

    t = threading.Thread(target=watch)
    t.start()
    try:
        lines = R.QUERIES["drain_docs"](spark, str(tmp_path)).agg(F.sum("lines")).first()[0]
    finally:
        over.set()
        t.join()
    assert lines == 300 * 40
    assert peak[0] < 4 * _bytes([tmp_path / "documents.parquet"]), peak
