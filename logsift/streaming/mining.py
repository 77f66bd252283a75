"""Mining on a stream: Drain, template memory and session buckets.

* ``stream_drain``: the clusters of a Drain leaf as keyed state; a record gets its
  cluster's template at that moment, like the online miner, and clusters leave only
  by the cluster limit, least recently used first.
* ``memory_sink``: per micro-batch a native, partially aggregated fold (so a hot
  template costs a row per task) into a committed table, with the batch number in
  the commit; rows get their provenance from the memory before the batch.
* ``session_buckets``: sessions of equal masked messages with a gap, merged as late rows
  come, with a bounded number of exemplars each, emitted when the watermark has passed them.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import patterns as P
from ..functions.templates import mask, template_id, template_regex
from ..operators.drain import drain_leaf, leaf_key
from ..operators.sampling import epoch_us
from ..operators.templates import template_memory, with_provenance
from ..sinks.commits import Table
from .sampler import event_time, keep_map_state


class DrainLeaf(StatefulProcessor):
    """State of a leaf: its clusters (template and when it was last used), and how many there have been."""

    def __init__(self, sim: float, max_clusters: int | None, keys: list[str], columns: list[str]):
        self.sim, self.max_clusters, self.keys, self.columns = sim, max_clusters, keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "born bigint, used bigint")
        self.clusters = handle.getMapState("clusters", "cluster bigint", "template string, used bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "log_id"], kind="stable").reset_index(drop=True)
        born, used = self.counts.get() if self.counts.exists() else (0, 0)
        stored = {int(k[0]): (v[0], int(v[1])) for k, v in self.clusters.iterator()} if born else {}
        state = OrderedDict((c, t.split(" ")) for c, (t, _) in sorted(stored.items(), key=lambda x: x[1][1]))
        out, _ = drain_leaf(pdf["text"].tolist(), self.sim, self.max_clusters, state, born)
        touched = OrderedDict()  # in the order of their last use
        for c, _, _ in out:
            touched[c] = None
            touched.move_to_end(c)
        for c in touched:
            used += 1
            if c in state:
                self.clusters.updateValue((c,), (" ".join(state[c]), used))
        for c in stored:
            if c not in state:
                self.clusters.removeKey((c,))
        born += sum(not matched for _, _, matched in out)
        self.counts.update((born, used))
        res = pdf.assign(template=[t for _, t, _ in out], drain_cluster=[f"{key[-1]}#{c}" for c, _, _ in out], matched=[m for _, _, m in out])
        for i, k in enumerate(self.keys):
            res[k] = key[i]
        yield res[self.columns]

    def close(self) -> None:
        pass


def stream_drain(df: DataFrame, sim: float = P.DRAIN_SIM, depth: int = P.DRAIN_DEPTH, max_clusters: int | None = P.DRAIN_MAX_CLUSTERS,
                 context: tuple[str, ...] = (), message_col: str = "message", tenant_col: str = "tenant", carry: tuple[str, ...] = ()) -> DataFrame:
    """(log_id, ts, tenant, context, carried columns, template, template_id, regex, confidence,
    drain_cluster): every record through the online miner. Within a micro-batch a leaf's
    records come in (ts, log_id) order, those without a time last; blank messages have no template and confidence 0."""
    keep_map_state(df.sparkSession)
    keys = [tenant_col, *context]
    m = F.col(message_col)
    d = df.select("log_id", epoch_us().alias("ts_us"), *[F.col(k).cast("string").alias(k) for k in keys], *carry, m.alias("text"))
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    rows = d.where(~blank).withColumn("leaf", leaf_key(F.col("text"), depth))
    added = [T.StructField("template", T.StringType()), T.StructField("drain_cluster", T.StringType()), T.StructField("matched", T.BooleanType())]
    kinds = T.StructType([f for f in d.schema.fields if f.name != "text"] + added)
    mined = rows.groupBy(*keys, "leaf").transformWithStateInPandas(DrainLeaf(sim, max_clusters, keys, kinds.names), kinds, "Append", "None")
    none = d.where(blank).drop("text").withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    out = mined.unionByName(none).withColumn("ts", F.expr("timestampadd(MICROSECOND, ts_us, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    confidence = F.when(F.col("template").isNull(), F.lit(0.0)).when(F.col("matched"), F.lit(P.CONFIDENCE_MATCH)).otherwise(F.lit(P.CONFIDENCE_NEW))
    return (out.withColumn("template_id", template_id(F.col("template"))).withColumn("regex", template_regex(F.col("template"), "full"))
               .withColumn("confidence", confidence.cast("float")).drop("ts_us", "matched"))


def memory_sink(path: str, rows_path: str | None = None, writer: str = "memory", n_examples: int = P.EXEMPLARS_MAX) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer (M12, M11): fold a micro-batch's templates into the committed memory at ``path``,
    and, with ``rows_path``, store its rows with their provenance: HEURISTIC for the first row of a template the memory did not have.

    The rows of a batch are a folder of their own and written before the commit; a batch that is sent again before its commit replaces
    them, one that is sent again after it is skipped. So a restart from a checkpoint gives what one run gives."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        table = Table(spark, path, ["template_id"])
        before = table.version()
        if before.batches.get(writer, -1) >= batch_id:
            return
        batch = batch.persist()  # read by the rows and the fold
        try:
            if rows_path:
                with_provenance(batch, table.read(before)).write.mode("overwrite").parquet(f"{rows_path.rstrip('/')}/batch={batch_id}")
            memory = template_memory(batch, n_examples=n_examples, persist=False)
            table.merge(memory, lambda old, new: new if old is None else merge_memory(old, new, n_examples), writer, batch_id)
        finally:
            batch.unpersist()
    return write


def merge_memory(old: DataFrame, new: DataFrame, n_examples: int = P.EXEMPLARS_MAX) -> DataFrame:
    """Two memories as one: earliest and latest times, summed counts, the newest exemplars of both."""
    u = old.unionByName(new.select(*old.columns))
    newest = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("last_seen", "examples")), False), lambda s: s["examples"]))
    return u.groupBy("template_id").agg(
        F.max_by("template", "last_seen").alias("template"), F.max_by("regex", "last_seen").alias("regex"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"), F.slice(newest, 1, n_examples).alias("examples")).select(*old.columns)


class SessionBuckets(StatefulProcessor):
    """State of a group: its open sessions, each with its first messages, and how many have closed."""

    def __init__(self, gap_us: int, n_examples: int, keys: list[str], columns: list[str]):
        self.gap, self.n_examples, self.keys, self.columns = gap_us, n_examples, keys, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first_us bigint, last_us bigint, size bigint, examples string")
        self.closed = handle.getValueState("closed", "n bigint")

    def merged(self, sessions: list[tuple]) -> list[tuple]:
        """Sessions (first, last, size, examples) in order, those within the gap as one."""
        out: list[list] = []
        for first, last, size, examples in sorted(sessions, key=lambda s: s[:2]):
            if out and first <= out[-1][1] + self.gap:
                was = out[-1]
                out[-1] = [was[0], max(was[1], last), was[2] + size, sorted(was[3] + examples)[:self.n_examples]]
            else:
                out.append([first, last, size, examples])
        return [tuple(s) for s in out]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sessions = [(int(a), int(b), int(n), [tuple(x) for x in json.loads(e)]) for a, b, n, e in self.open.get()] if self.open.exists() else []
        for pdf in rows:  # one part of the group's rows at a time
            pdf = pdf.sort_values(["ts_us", "log_id"], kind="stable")
            own = []
            us = pdf["ts_us"].to_numpy()
            cuts = [0, *[i for i in range(1, len(us)) if us[i] > us[i - 1] + self.gap], len(us)]
            for lo, hi in zip(cuts, cuts[1:]):
                some = pdf.iloc[lo:min(hi, lo + self.n_examples)]
                own.append((int(us[lo]), int(us[hi - 1]), hi - lo, [(int(t), int(i), x) for t, i, x in zip(some["ts_us"], some["log_id"], some["message"])]))
            sessions = self.merged(sessions + own)
        self.open.put([(a, b, n, json.dumps(e)) for a, b, n, e in sessions])
        self._remind(sessions)
        return iter([])

    def _remind(self, sessions: list[tuple]) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if sessions:
            self.handle.registerTimer((min(s[1] for s in sessions) + self.gap) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = int(timerValues.getCurrentWatermarkInMs()) * 1000
        sessions = [(int(a), int(b), int(n), e) for a, b, n, e in self.open.get()]
        over = [s for s in sessions if s[1] + self.gap < now]
        left = [s for s in sessions if s[1] + self.gap >= now]
        if left:
            self.open.put(left)
            self.handle.registerTimer((min(s[1] for s in left) + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        n = self.closed.get()[0] if self.closed.exists() else 0
        self.closed.update((n + len(over),))
        if over:
            out = pd.DataFrame({"bucket": range(n + 1, n + 1 + len(over)), "size": [s[2] for s in over], "first_us": [s[0] for s in over],
                                "last_us": [s[1] for s in over], "exemplars": [[x[2] for x in json.loads(s[3])] for s in over]})
            for i, k in enumerate(self.keys):
                out[k] = key[i]
            yield out[self.columns]

    def close(self) -> None:
        pass


def session_buckets(df: DataFrame, ttl: str = "5 minutes", key: str = "tenant", n_examples: int = 3, watermark: str = "10 minutes") -> DataFrame:
    """M16 on a stream: the closed buckets of ``grouping_buckets``, (key, masked, bucket, size, first_seen, last_seen,
    exemplars), once the watermark has passed them. Records later than the watermark are dropped, as Spark does with
    late rows; records without a time are in no session and left out (``grouping_buckets`` has them under a null time)."""
    keep_map_state(df.sparkSession)
    gap, keys = _micros(ttl), [key, "masked"]
    rows = event_time(df.where(F.col("ts").isNotNull())).withWatermark("event_time", watermark)
    rows = rows.select("event_time", F.col("log_id").cast("bigint").alias("log_id"), epoch_us().alias("ts_us"), F.col(key).cast("string").alias(key),
                       mask(F.col("message")).alias("masked"), "message")
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in keys] + [T.StructField(c, T.LongType()) for c in ("bucket", "size", "first_us", "last_us")]
                         + [T.StructField("exemplars", T.ArrayType(T.StringType()))])
    out = rows.groupBy(*keys).transformWithStateInPandas(SessionBuckets(gap, n_examples, keys, kinds.names), kinds, "Append", "EventTime")
    at = lambda c: F.expr(f"timestampadd(MICROSECOND, {c}, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
    return out.select(*keys, "bucket", "size", at("first_us").alias("first_seen"), at("last_us").alias("last_seen"), "exemplars")


def _micros(interval: str) -> int:
    """Microseconds of an interval such as ``5 minutes``."""
    return int(pd.Timedelta(interval).value // 1000)
