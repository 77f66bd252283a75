"""Job 10: reports over the other jobs' outputs.

Every report is a grouped aggregate (map-side partial aggregation) or a
join against a small, size-checked rules table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import checked_broadcast


def records_by_schema(df: DataFrame) -> DataFrame:
    """A4: records by source protocol x detected schema."""
    return df.groupBy("protocol", "schema").agg(F.count(F.lit(1)).alias("records"))


def rejects_by_reason(rejects: DataFrame) -> DataFrame:
    """A5."""
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))


def decisions_by_reason(decided: DataFrame) -> DataFrame:
    """Decisions by action x reason, and enforced by action."""
    return decided.groupBy("action", "keep_reason").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(F.col("enforced"), 1)).alias("enforced"))


def sampling_metrics(decided: DataFrame, by: list[str] = ("key_tenant",)) -> DataFrame:
    """Processed, kept, suppressed, kept ratio and per-reason counts."""
    reasons = ["SEVERITY", "NOVEL", "SPIKE", "WARMUP", "LOG2", "BUDGET", "STEADYK"]
    return decided.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count(F.when(F.col("action") == "KEEP", 1)).alias("kept"),
        F.count(F.when(F.col("action") == "SUPPRESS", 1)).alias("suppressed"),
        *[F.count(F.when((F.col("action") == "KEEP") & (F.col("keep_reason") == r), 1)).alias(f"kept_{r.lower()}")
          for r in reasons]) \
        .withColumn("sample_rate", F.col("kept") / F.col("processed"))


def suppressed_rollup(suppressed: DataFrame, window: str = "1 minute", size: Column | None = None) -> DataFrame:
    """Suppressed lines become metrics-only counts per window x key; ``size`` is a
    line's bytes, by default those of its ``message``."""
    size = F.octet_length("message") if size is None else size
    return suppressed.groupBy(F.window("ts", window)["start"].alias("window_start"),
                              "key_tenant", "template_id", "key_service", "key_env", "severity") \
        .agg(F.count(F.lit(1)).alias("suppressed"), F.sum(size).alias("bytes"))


def tenant_volume(decided: DataFrame, tenant: str = "key_tenant") -> DataFrame:
    """Bytes and lines per tenant, kept ratio (cost attribution)."""
    b = F.octet_length("payload")
    kept = F.col("action") == "KEEP"
    return decided.groupBy(tenant).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(b).alias("bytes_in"),
        F.sum(F.when(kept, b).otherwise(0)).alias("bytes_kept"),
        F.count(F.when(kept, 1)).alias("lines_kept")) \
        .withColumn("kept_ratio", F.col("lines_kept") / F.col("lines"))


def active_streams(entries: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct stream keys (exact, or HyperLogLog++ approximate)."""
    f = F.countDistinct("stream_key") if exact else F.approx_count_distinct("stream_key")
    return entries.agg(f.alias("active_streams"))


def label_cardinality(df: DataFrame, rsd: float = 0.01) -> DataFrame:
    """Per label key, approximate distinct values (flags high-cardinality
    labels that should not be stream or catalog labels)."""
    e = df.select(F.explode("labels").alias("k", "v"))
    return e.groupBy("k").agg(F.approx_count_distinct("v", rsd).alias("approx_distinct"),
                              F.count(F.lit(1)).alias("rows"))


def histogram(df: DataFrame, col: Column, edges: list[float], by: list[str] = ()) -> DataFrame:
    """Counts per fixed bucket: bucket i holds edges[i-1] < x <= edges[i];
    the last bucket is +Inf."""
    b = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        b = F.when(col <= edges[i], F.lit(i)).otherwise(b)
    le = F.element_at(F.array(*[F.lit(str(e)) for e in edges], F.lit("+Inf")), b + 1)
    return df.groupBy(*by, b.alias("bucket"), le.alias("le")).agg(F.count(F.lit(1)).alias("count"))


def alerts(mined: DataFrame, rules: DataFrame, window: str = "1 hour") -> DataFrame:
    """Windowed rate per template joined with alert rules (template_id,
    min_count, min_ratio): fire when the window count reaches min_count and
    the ratio to the previous window of the same template reaches min_ratio.
    The lag runs over the per-template window rollup, not over raw rows."""
    r = mined.groupBy("template_id", F.window("ts", window)["start"].alias("window_start")) \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("template_id").orderBy("window_start")
    r = r.withColumn("prev_n", F.lag("n").over(w))
    b = checked_broadcast(rules, "alert rules")
    j = r.join(b if b is not None else rules, "template_id")
    ratio = F.col("n") / F.col("prev_n")
    return j.filter((F.col("n") >= F.col("min_count")) &
                    (F.col("prev_n").isNull() | (ratio >= F.col("min_ratio")))) \
        .withColumn("ratio", ratio)


def correlate_deploys(templates: DataFrame, deploys: DataFrame, key: str = "service") -> DataFrame:
    """Latest deployment at or before each template's first_seen (as-of join
    as union + last-non-null over (service, time), so no range join)."""
    t = templates.select(key, F.col("first_seen").alias("__t"), "template_id", F.lit(None).cast("string").alias("deploy_id"),
                         F.lit(1).alias("__kind"))
    d = deploys.select(key, F.col("deployed_at").alias("__t"), F.lit(None).cast("string").alias("template_id"),
                       F.col("deploy_id").cast("string"), F.lit(0).alias("__kind"))
    u = t.unionByName(d)
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("last_deploy", F.last("deploy_id", ignorenulls=True).over(w)) \
        .withColumn("last_deploy_at", F.last(F.when(F.col("__kind") == 0, F.col("__t")), ignorenulls=True).over(w))
    return u.filter(F.col("__kind") == 1).select(key, "template_id", F.col("__t").alias("first_seen"),
                                                 "last_deploy", "last_deploy_at")
