"""Raw log tables derived from the driver tables.

Each view has the raw-log contract columns
``(log_id, ts, labels, payload, format_hint, protocol)`` plus flat label
columns (tenant, service, env, severity) so that later stages can partition
and prune on plain columns instead of map lookups. The same projections are
written in SQL in ``logsift.oracle_sql`` so the DuckDB oracle sees identical
inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
DOC_LINE_STRIDE = 1_000_000  # log_id = doc_id * stride + line_no


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def balanced(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when the scan has fewer splits than the
    cluster's parallelism (e.g. one large row group). The downstream stages
    are CPU-bound regex/hash work, so one round-robin shuffle of the raw rows
    is cheaper than running them on a few cores; round-robin repartitioning
    sorts first, so a retried task sees the same rows. Inputs that already
    have enough splits (the normal case on a cluster) are left untouched."""
    if df.isStreaming:
        return df
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= target:
            return df
    except (AttributeError, NotImplementedError):  # no RDD API (Spark Connect)
        return df
    return df.repartition(target)


def _labels(tenant, service, env, severity):
    return F.create_map(F.lit("tenant"), tenant, F.lit("service"), service,
                        F.lit("env"), env, F.lit("severity"), F.lower(severity))


def event_severity(event_type):
    return (F.when(event_type == "error", "ERROR").when(event_type == "purchase", "WARN")
            .when(event_type == "signup", "INFO").otherwise("DEBUG"))


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: ``user <id> <type> value=<cents> props=<json>``."""
    return log_events_from(read_table(spark, sf_dir, "events"))


def log_events_from(e: DataFrame) -> DataFrame:
    """``log_events`` over any events frame (batch or ``readStream``)."""
    tenant = F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))
    env = F.when(F.col("user_id") % 2 == 0, "prod").otherwise("dev")
    sev = event_severity(F.col("event_type"))
    msg = F.concat_ws(" ", F.lit("user"), F.col("user_id").cast("string"), F.col("event_type"),
                      F.concat(F.lit("value="), F.round(F.col("value") * 100).cast("bigint").cast("string")),
                      F.concat(F.lit("props="), F.col("props")))
    return balanced(e).select(
        F.col("event_id").alias("log_id"), F.col("ts"),
        tenant.alias("tenant"), F.col("event_type").alias("service"), env.alias("env"),
        sev.alias("severity"),
        _labels(tenant, F.col("event_type"), env, sev).alias("labels"),
        msg.alias("payload"), F.lit("").alias("format_hint"), F.lit("table").alias("protocol"))


def log_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per document line (whole texts, every line)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = d.select("doc_id", "lang", "source", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("line_no", "line"))
    d = balanced(d)
    ts = F.expr(f"timestampadd(SECOND, doc_id * 60 + line_no, {EPOCH_NTZ})")
    return d.select(
        (F.col("doc_id") * DOC_LINE_STRIDE + F.col("line_no")).alias("log_id"),
        ts.alias("ts"),
        F.col("source").alias("tenant"), F.col("lang").alias("service"), F.lit("prod").alias("env"),
        F.lit("INFO").alias("severity"),
        _labels(F.col("source"), F.col("lang"), F.lit("prod"), F.lit("INFO")).alias("labels"),
        F.col("line").alias("payload"), F.lit("").alias("format_hint"), F.lit("table").alias("protocol"),
        F.col("doc_id"), F.col("line_no").cast("bigint").alias("line_no"))


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawler access line per page: ``fetch <url> status=200 bytes=<n>``."""
    p = read_table(spark, sf_dir, "pages")
    ts = F.expr(f"timestampadd(MINUTE, page_id, {EPOCH_NTZ})")
    msg = F.concat(F.lit("fetch "), F.col("url"), F.lit(" status=200 bytes="),
                   F.octet_length("html").cast("string"))
    return balanced(p).select(
        F.col("page_id").alias("log_id"), ts.alias("ts"),
        F.lit("web").alias("tenant"), F.lit("crawler").alias("service"), F.lit("prod").alias("env"),
        F.lit("INFO").alias("severity"),
        _labels(F.lit("web"), F.lit("crawler"), F.lit("prod"), F.lit("INFO")).alias("labels"),
        msg.alias("payload"), F.lit("").alias("format_hint"), F.lit("table").alias("protocol"))
