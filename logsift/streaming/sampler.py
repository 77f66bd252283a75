"""Structured Streaming: the same operators on unbounded input.

* ``stream_mined``: stateless normalize + redact + mask templates on a
  ``readStream`` frame (identical column code to the batch path).
* ``deduplicated``: records seen before within a time are dropped.
* ``windowed_rollup``: A8/A11 as watermarked tumbling windows (append mode).
* ``stream_counters``: the sampler's counters as keyed state, kept by
  ``transformWithState``: total, first occurrence and EMA for good, counts per minute
  for 26 hours. ``stateful_decide`` puts the ladder of the batch path on top, so there
  is one ladder. Records of a key inside a micro-batch are counted in (ts, log_id)
  order, exactly like the batch path.
* ``catalog_sink``: ``foreachBatch`` upsert of the template catalog whose commit
  carries the batch number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.normalize import normalize
from ..operators.sampling import KEY, WINDOWS, Policy, ema_alpha, epoch_us, with_decision, with_key
from ..operators.templates import with_templates

BUCKET_TTL_MIN = 26 * 60
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COUNTED = ["seq", "cur_min", "count_10m", "count_1h", "count_24h"]


def stream_mined(raw: DataFrame) -> DataFrame:
    """Stateless part of the pipeline on a streaming frame."""
    return with_templates(normalize(raw))


def event_time(df: DataFrame) -> DataFrame:
    """Watermarks need an instant type: ``event_time`` = the UTC wall-clock
    ``ts`` as TIMESTAMP, independent of the session time zone."""
    return df.withColumn("event_time", F.timestamp_micros(epoch_us()))


def windowed_rollup(df: DataFrame, window: str = "1 minute", watermark: str = "26 hours",
                    by: list[str] = ("service",)) -> DataFrame:
    """Tumbling-window counts with a watermark, emitted once per closed window."""
    return (event_time(df).withWatermark("event_time", watermark)
              .groupBy(F.window("event_time", window).alias("w"), *by)
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("w.start").alias("window_start"), *by, "n"))


def deduplicated(df: DataFrame, within: str = "26 hours", key: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """One record per key: repeats that come within that event time are dropped, and the
    state of a key goes once the watermark has passed it. Records that are late by more
    than that are dropped as well, as Spark does with late rows; records without a time have no place in that
    order and all pass."""
    timed = event_time(df.where(F.col("ts").isNotNull())).withWatermark("event_time", within)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("event_time").unionByName(df.where(F.col("ts").isNull()))


def keep_map_state(spark: SparkSession) -> None:
    """Use the one state store that has map state and timers, where another one is set."""
    if spark.conf.get(STATE_STORE, "").rsplit(".", 1)[-1] != ROCKSDB.rsplit(".", 1)[-1]:
        spark.conf.set(STATE_STORE, ROCKSDB)


class MinuteCounts:
    """Counters of one key's records in order, from its state (pure numpy, used by the processor)."""

    def __init__(self, total: int, ema: float, first_us: int | None, minutes: dict[int, int], alpha: float, inclusive: bool):
        self.total, self.ema, self.first_us, self.minutes = total, ema, first_us, minutes
        self.alpha, self.inclusive = alpha, inclusive

    def count(self, us: np.ndarray) -> dict[str, np.ndarray]:
        """Counters of records at sorted times ``us`` (microseconds); the state moves on."""
        minute, n = us // 60_000_000, len(us)
        known = np.array(sorted(self.minutes), dtype=np.int64)
        upto = np.concatenate([[0], np.cumsum([self.minutes[m] for m in known.tolist()])]).astype(np.int64)

        def earlier(at: np.ndarray, side: str) -> np.ndarray:
            return upto[np.searchsorted(known, at, side)]

        place = np.arange(n)
        out = {"seq": self.total + place + 1,
               "cur_min": earlier(minute, "right") - earlier(minute, "left") + place + 1 - np.searchsorted(minute, minute)}
        for span, name in WINDOWS:
            lowest = minute - (span if self.inclusive else span - 1)
            out[name] = earlier(minute, "right") - earlier(lowest, "left") + place + 1 - np.searchsorted(minute, lowest)
        ema = np.empty(n)
        for i, c in enumerate(out["cur_min"].tolist()):
            ema[i] = self.ema = self.alpha * c + (1.0 - self.alpha) * self.ema
        out["ema"] = ema
        self.first_us = int(us[0]) if self.first_us is None else min(self.first_us, int(us[0]))
        out["first_us"] = np.full(n, self.first_us)
        self.total += n
        for m, c in zip(*np.unique(minute, return_counts=True), strict=True):
            self.minutes[int(m)] = self.minutes.get(int(m), 0) + int(c)
        return out


class SamplerCounters(StatefulProcessor):
    """State of a sampler key. ``totals`` (records so far, EMA, first occurrence, the timer) never
    expires; ``minutes`` holds the counts of the last 26 hours: older minutes go when the key is
    seen, all of them by a timer when nothing of it has arrived for so long."""

    def __init__(self, alpha: float, inclusive: bool, ttl_minutes: int, columns: list[str]):
        self.alpha, self.inclusive, self.ttl, self.columns = alpha, inclusive, ttl_minutes, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "total bigint, ema double, first_us bigint, timer bigint")
        self.minutes = handle.getMapState("minutes", "minute bigint", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        timed = pdf[pdf["ts_us"].notna()].sort_values(["ts_us", "log_id"], kind="stable").reset_index(drop=True)
        out = [pdf[pdf["ts_us"].isna()]]
        if len(timed):
            total, ema, first_us, timer = self.totals.get() if self.totals.exists() else (0, 0.0, None, None)
            stored = {int(k[0]): int(v[0]) for k, v in self.minutes.iterator()} if total else {}
            state = MinuteCounts(total, ema, first_us, dict(stored), self.alpha, self.inclusive)
            counted = state.count(timed["ts_us"].to_numpy().astype(np.int64))
            out.append(timed.assign(**counted))
            lowest = max(state.minutes) - self.ttl
            for m, n in state.minutes.items():
                if m >= lowest and stored.get(m) != n:
                    self.minutes.updateValue((m,), (n,))
                elif m < lowest and m in stored:
                    self.minutes.removeKey((m,))
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(pdf["arrived_ms"].max()) + self.ttl * 60_000
            self.handle.registerTimer(timer)
            self.totals.update((state.total, float(state.ema), state.first_us, timer))
        res = pd.concat([f for f in out if len(f)], ignore_index=True)
        for i, k in enumerate(KEY):
            res[k] = key[i]
        for c in (*COUNTED, "first_us", "ema"):
            if c not in res:
                res[c] = None
            if c != "ema":
                res[c] = res[c].astype("Int64")
        yield res[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.minutes.clear()
        total, ema, first_us, _ = self.totals.get()
        self.totals.update((total, ema, first_us, None))
        return iter([])

    def close(self) -> None:
        pass


def stream_counters(mined: DataFrame, policy: Policy = Policy(), inclusive: bool = True, carry: tuple[str, ...] = (),
                    ttl_minutes: int = BUCKET_TTL_MIN) -> DataFrame:
    """W1-W6 on a stream: the counters of ``with_counters`` for each record, as state per key.

    A record without a time gets null counters and changes no state. Counts of a record
    more than two hours behind its key's newest one miss minutes that have expired. A key's records of one micro-batch
    are handled in one task, with their ids, times and the columns to ``carry``."""
    keep_map_state(mined.sparkSession)
    # Timers follow the time of arrival, as the expiry of a key-value store does. It is the same for all
    # rows of a micro-batch and never late, so no row is dropped, whatever its own time.
    k = with_key(mined).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "1 hour")
    k = k.select("log_id", epoch_us().alias("ts_us"), *KEY, *carry, "arrived", F.unix_millis("arrived").alias("arrived_ms"))
    plain = T.StructType([k.schema[c] for c in ("log_id", "ts_us", *KEY, *carry)]
                         + [T.StructField(c, T.LongType()) for c in (*COUNTED, "first_us")] + [T.StructField("ema", T.DoubleType())])
    counted = k.groupBy(*KEY).transformWithStateInPandas(
        SamplerCounters(ema_alpha(policy.half_life), inclusive, ttl_minutes, plain.names), plain, "Append", "EventTime")
    # Wall-clock times again, whatever the session's time zone.
    for us, ts in (("ts_us", "ts"), ("first_us", "key_first_seen")):
        counted = counted.withColumn(ts, F.expr(f"timestampadd(MICROSECOND, {us}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    return counted.withColumn("cur_minute", F.floor(F.col("ts_us") / 60_000_000)).drop("ts_us", "first_us")


def stateful_decide(mined: DataFrame, policy: Policy = Policy(), inclusive: bool = True, policies: DataFrame | None = None,
                    carry: tuple[str, ...] = (), ttl_minutes: int = BUCKET_TTL_MIN) -> DataFrame:
    """W1-W14, W20 on a stream: counters from keyed state, then the ladder of the batch path."""
    return with_decision(stream_counters(mined, policy, inclusive, carry, ttl_minutes), policy, policies)


def catalog_sink(path: str, writer: str = "catalog"):
    """foreachBatch writer: fold each micro-batch's candidates into the committed
    catalog table (U1). The commit carries the batch number of ``writer``, so a batch
    that is sent again after a failure changes nothing."""
    from ..operators.catalog import to_candidates, upsert_catalog
    from ..operators.templates import with_provenance

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_catalog(path, to_candidates(with_provenance(batch)), writer, batch_id)
    return write
