"""Job 5: decided_logs -> enriched lines, streams, push payloads, files
(K1-K8, N12, W22).

Push batching is per (stream, minute): a streaming fold over sorted partitions
ends a chunk with the entry that fills it, so every payload row is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.text import default_labels, keep_labels


def rfc3339(ts: Column) -> Column:
    """UTC wall-clock timestamp -> RFC 3339 with trimmed fractional seconds."""
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.regexp_replace(F.date_format(ts, "SSSSSS"), "0+$", "")
    return F.concat(base, F.when(F.length(frac) > 0, F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("Z"))


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def html_escape_json(s: Column) -> Column:
    """Escape <, > and & inside JSON text the way Go's encoder does."""
    return F.replace(F.replace(F.replace(s, F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")),
                     F.lit("&"), F.lit("\\u0026"))


def enrich_line(df: DataFrame, html_escape: bool = True) -> DataFrame:
    """K1: the shipped line: JSON with keys sorted, optional keys absent when
    empty or false."""
    shadow = F.coalesce(F.col("shadow"), F.lit(False))
    reason = F.col("keep_reason")

    def opt_true(c):
        return F.when(F.coalesce(c, F.lit(False)), F.lit(True))

    applied = F.col("redaction.applied")
    fields = [
        F.lower(F.col("action")).alias("action"),
        F.when(reason.isNotNull(), ~shadow).alias("enforced"),
        F.when(~shadow, reason).alias("keep_reason"),
        F.when(shadow, reason).alias("keep_reason_shadow"),
        _sorted_map(F.col("labels")).alias("labels"),
        F.col("message").alias("message"),
        F.when(F.length("policy_version") > 0, F.col("policy_version")).alias("policy_version"),
        opt_true(applied).alias("redaction_applied"),
        F.when(applied, F.col("redaction.count")).alias("redaction_count"),
        F.when(applied, F.col("redaction.rules")).alias("redaction_rules"),
        F.when(F.col("sample_rate") > 0, F.col("sample_rate")).alias("sample_rate"),
        opt_true(F.col("sanitized")).alias("sanitized"),
        F.when(F.length("schema") > 0, F.col("schema")).alias("schema"),
        opt_true(shadow).alias("shadow"),
        F.when(F.length("template_id") > 0, F.col("template_id")).alias("template_id"),
        opt_true(F.col("truncated")).alias("truncated"),
        rfc3339(F.col("ts")).alias("ts"),
    ]
    line = F.to_json(F.struct(*fields))
    return df.withColumn("line", html_escape_json(line) if html_escape else line)


def stream_key(labels: Column, static: dict | None = None) -> Column:
    """K2: five labels (+ static labels, which win), sorted ``k=v`` joined by ','."""
    m = keep_labels(labels, P.STREAM_LABELS)
    if static:
        st = F.create_map(*[x for k, v in static.items() for x in (F.lit(k), F.lit(v))])
        m = F.map_concat(F.map_filter(m, lambda k, v: ~k.isin(*static.keys())), st)
    ents = F.array_sort(F.map_entries(m))
    return F.array_join(F.transform(ents, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def to_sink_entries(kept: DataFrame, static: dict | None = None) -> DataFrame:
    """N12 + K1 + K2: default labels, enriched line, stream key."""
    e = enrich_line(kept).withColumn("sink_labels", default_labels(F.col("labels")))
    return e.withColumn("stream_key", stream_key(F.col("sink_labels"), static))


def _greedy_cut(max_entries: int, max_bytes: int):
    """Chunk numbers of entries that come stream by stream, in order: a chunk ends
    with the entry that fills it (entries or bytes), and both counts begin anew.
    Only the counts of the stream at hand are kept between batches; inside a batch
    the end of a chunk is looked up in running sums, so the work is a step per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, chunk, n, total = None, 0, 0, 0
        for batch in batches:
            key, minute = batch.column("stream_key"), batch.column("minute")
            codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
            times = minute.fill_null(-1).to_numpy()
            sizes = batch.column("entry_bytes").fill_null(0).to_numpy()
            out = np.empty(len(sizes), dtype=np.int64)
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(times) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
                if lo == hi:
                    continue
                own = (key[int(lo)].as_py(), minute[int(lo)].as_py())
                if own != stream:
                    stream, chunk, n, total = own, 0, 0, 0
                upto = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
                i, m = 0, int(hi - lo)
                while i < m:
                    if n >= max_entries or total >= max_bytes:
                        chunk, n, total = chunk + 1, 0, 0
                    j = min(i + max_entries - n, int(np.searchsorted(upto, upto[i] + max_bytes - total)), m)
                    out[lo + i:lo + j] = chunk
                    n, total, i = n + j - i, total + int(upto[j] - upto[i]), j
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "chunk"])
    return run


def push_chunks(entries: DataFrame, max_entries: int = P.SINK_MAX_ENTRIES,
                max_bytes: int = P.SINK_MAX_BYTES, overhead: int = P.SINK_ENTRY_OVERHEAD, minutes: int = 1) -> DataFrame:
    """K3: ``chunk`` numbers per (stream, minute): at most ``max_entries``, cut
    after reaching ``max_bytes`` (bytes = len(line) + overhead). The fold needs a
    stream's order; it streams over sorted partitions and holds no group."""
    from ..operators.sampling import epoch_us
    e = entries.withColumn("minute", (F.floor(epoch_us() / (60_000_000 * minutes)) * minutes).cast("bigint")) \
        .withColumn("entry_bytes", (F.octet_length("line") + overhead).cast("bigint"))
    e = e.repartition("stream_key", "minute").sortWithinPartitions("stream_key", "minute", "ts", "log_id")
    return e.mapInArrow(_greedy_cut(max_entries, max_bytes), T.StructType([*e.schema.fields, T.StructField("chunk", T.LongType())]))


def push_payloads(chunked: DataFrame, fmt: str = "values") -> DataFrame:
    """K3 payload per chunk (bounded): ``values`` = sink format
    ``{"streams":[{"stream":{...},"values":[[ns, line],...]}]}``; ``entries`` =
    the push input format ``{"streams":[{"labels":"{k=\\"v\\"}","entries":[{"ts","line"}]}]}``."""
    from ..operators.sampling import epoch_us
    key = ["stream_key", "minute", "chunk"]
    if fmt == "values":
        item = F.struct("ts", "log_id", F.array((epoch_us() * 1000).cast("string"), F.col("line")).alias("v"))
    else:
        item = F.struct("ts", "log_id", F.struct(rfc3339(F.col("ts")).alias("ts"), F.col("line").alias("line")).alias("v"))
    g = chunked.groupBy(*key).agg(F.first("sink_labels").alias("labels"),
                                  F.sort_array(F.collect_list(item)).alias("items"),
                                  F.count(F.lit(1)).alias("entries"), F.sum("entry_bytes").alias("bytes"))
    vals = F.transform("items", lambda x: x["v"])
    if fmt == "values":
        doc = F.struct(F.array(F.struct(_sorted_map(keep_labels(F.col("labels"), P.STREAM_LABELS)).alias("stream"),
                                        vals.alias("values"))).alias("streams"))
    else:
        from ..functions.text import label_string
        doc = F.struct(F.array(F.struct(label_string(F.col("labels"), P.STREAM_LABELS).alias("labels"),
                                        vals.alias("entries"))).alias("streams"))
    return g.select(*key, "entries", "bytes", F.to_json(doc).alias("payload"))


def shed(entries: DataFrame, budget_entries: int, debug_first: bool = True, protect_info: bool = True,
         window: str = "1 minute") -> tuple[DataFrame, DataFrame]:
    """K4: per window, entries beyond the buffer budget (in arrival order) are
    dropped when droppable: debug; info only if not protected; never others."""
    from ..operators.ordered import running_sum
    minute = F.date_trunc("minute", F.col("ts")) if window == "1 minute" else F.window("ts", window)["start"]
    e = running_sum(entries.withColumn("__win", minute), ["__win"], None, "__pos")
    sev = F.lower(F.coalesce(F.col("sink_labels")["severity"], F.lit("info")))
    droppable = (sev == "debug") if not debug_first else ((sev == "debug") | ((sev == "info") & F.lit(not protect_info)))
    over = F.col("__pos") > budget_entries
    dropped = e.filter(over & droppable).withColumn("reason", F.lit("buffer_full")).drop("__win", "__pos")
    kept = e.filter(~(over & droppable)).drop("__win", "__pos")
    return kept, dropped


def write_logs(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
               compression: str | None = None) -> None:
    """K5-K7: batch sink (parquet/json), partitioned by tenant and date."""
    w = df.write.mode("append").format(fmt)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def kept_table(df: DataFrame) -> DataFrame:
    """K7: columns for the partitioned kept-log table (tenant, date partitions)."""
    return df.withColumn("date", F.to_date("ts"))


def retain(df: DataFrame, policies: DataFrame, now, key: str = "tenant") -> DataFrame:
    """K8: keep rows younger than the tenant's retention (days); tenants without
    a policy keep everything, and so does a record without a time, whose age nobody
    knows. A cutoff on the column ``date`` of a partitioned table prunes its partitions first."""
    j = df.join(policies.select(key, "retention_days"), key, "left")
    n = F.lit(now).cast("timestamp_ntz") if not isinstance(now, Column) else now
    cutoff = F.expr("timestampadd(DAY, -retention_days, __now)")
    keep = F.col("retention_days").isNull() | F.col("ts").isNull() | (F.col("ts") >= cutoff)
    if "date" in df.columns:
        keep = keep & (F.col("retention_days").isNull() | F.col("date").isNull() | (F.col("date") >= F.to_date(cutoff)))
    return j.withColumn("__now", n).filter(keep).drop("__now", "retention_days")
