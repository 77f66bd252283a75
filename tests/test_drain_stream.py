"""Drain leaf decomposition and streaming = batch for the sampler."""
import os

from pyspark.sql import functions as F

from logsift.operators.drain import drain, drain_leaf
from logsift.operators.sampling import decide
from logsift.operators.templates import with_templates
from logsift.operators.normalize import normalize
from logsift.sources.tables import log_events, log_events_from

SF = "/root/testdata/sf0.001"


def _whole_tree(messages):
    """Sequential Drain over all messages with explicit leaf routing."""
    leaves = {}
    out = {}
    for m in messages:
        toks = m.split()
        key = (len(toks), tuple("<*>" if any(c.isdigit() for c in t) else t for t in toks[:2]))
        leaves.setdefault(key, []).append(m)
    for key, msgs in leaves.items():
        res, final = drain_leaf(msgs)
        for m, (c, _, _) in zip(msgs, res):
            out[m] = final[c]
    return out


def test_drain_equals_sequential(spark):
    n = normalize(log_events(spark, SF))
    d = drain(n).select("log_id", "message", "template", "tenant", "ts").collect()
    for tenant in {r.tenant for r in d}:
        rows = sorted([r for r in d if r.tenant == tenant], key=lambda r: (r.ts, r.log_id))
        seen, msgs = set(), []
        for r in rows:
            if r.message not in seen:
                seen.add(r.message)
                msgs.append(r.message)
        want = _whole_tree(msgs)
        for r in rows:
            assert r.template == want[r.message]


def test_streaming_sampler_equals_batch(spark, tmp_path):
    from logsift.streaming.sampler import stateful_decide, stream_mined
    schema = spark.read.parquet(os.path.join(SF, "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    mined = stream_mined(log_events_from(stream))
    q = (stateful_decide(mined).writeStream.format("memory").queryName("decided_stream")
         .option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.log_id: (r.seq, r.action, r.keep_reason) for r in spark.sql("SELECT * FROM decided_stream").collect()}
    batch = decide(with_templates(normalize(log_events(spark, SF))))
    want = {r.log_id: (r.seq, r.action, r.keep_reason) for r in batch.collect()}
    assert got == want


def test_streaming_rollup_and_catalog_sink(spark, tmp_path):
    from logsift.operators.catalog import fold_catalog, read_current, to_candidates
    from logsift.operators.templates import with_provenance
    from logsift.streaming.sampler import catalog_sink, stream_mined, windowed_rollup
    schema = spark.read.parquet(os.path.join(SF, "events.parquet")).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    mined = stream_mined(log_events_from(stream))
    q1 = (windowed_rollup(mined, "1 day", "1 hour").writeStream.format("memory").queryName("roll_stream")
          .option("checkpointLocation", str(tmp_path / "ck1")).outputMode("append")
          .trigger(availableNow=True).start())
    q1.awaitTermination(300)
    cat_path = str(tmp_path / "catalog")
    q2 = (mined.writeStream.foreachBatch(catalog_sink(cat_path))
          .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination(300)
    batch = with_templates(normalize(log_events(spark, SF)))
    want_roll = {(r.d, r.service): r.n for r in batch.groupBy(F.date_trunc("day", "ts").alias("d"), "service")
                 .count().withColumnRenamed("count", "n").collect()}
    got_roll = spark.sql("SELECT * FROM roll_stream").collect()
    assert got_roll, "closed windows must be emitted"
    for r in got_roll:
        assert want_roll[(r.window_start.replace(tzinfo=None), r.service)] == r.n
    got = {(r.tenant, r.template_id, r.first_seen, r.last_seen) for r in read_current(spark, cat_path).collect()}
    want = {(r.tenant, r.template_id, r.first_seen, r.last_seen)
            for r in fold_catalog(to_candidates(with_provenance(batch))).collect()}
    assert got == want
