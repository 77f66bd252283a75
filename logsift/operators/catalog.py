"""Job 6: mined_logs -> templates, template_stats, template_events
(U1-U3, U6, U7, N11, N15, A2, A3, A9, A10, A12, A16, J6).

All catalog work is a fold by (tenant, template_id): hash aggregation with
map-side partial aggregation, so per-template volume does not matter. Upserts
are expressed as ``union(prior, new) -> fold`` over the buckets a batch touches and
committed as a new table version (``upsert_*``, ``sinks.commits``); no external
store is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.templates import template_version
from ..functions.text import catalog_labels
from ..sinks.commits import Table

CATALOG_KEY = ["tenant", "template_id"]


def catalog_tenant(labels: Column) -> Column:
    """The catalog uses the ``tenant`` label only (blank -> default)."""
    return F.coalesce(F.nullif(F.trim(labels["tenant"]), F.lit("")), F.lit("default"))


def to_candidates(mined: DataFrame) -> DataFrame:
    """U3 + U6 + N11: one candidate per (tenant, template) of the batch, folded
    from the per-record candidates: labels are the record labels + tenant,
    sanitized to the allow list; version = sha1(template + '\\n' + regex)."""
    m = mined.filter(~F.col("from_fallback"))
    m = m.withColumn("__tenant", catalog_tenant(F.col("labels")))
    # The latest record's values travel once, and its labels are sanitized after the fold: their tenant is the group's.
    more = ["provenance"] if "provenance" in m.columns else []
    latest = F.max_by(F.struct("template", "regex", "labels", *more), F.struct("ts", "log_id"))
    g = m.groupBy(F.col("__tenant").alias("tenant"), "template_id").agg(
        latest.alias("__latest"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    labels = catalog_labels(F.map_concat(
        F.map_filter(F.col("__latest.labels"), lambda k, v: k != "tenant"), F.create_map(F.lit("tenant"), F.col("tenant"))))
    return g.select(
        "tenant", "template_id", F.col("__latest.template").alias("template_text"), F.col("__latest.regex").alias("regex"),
        labels.alias("labels"), "first_seen", "last_seen", "n", *[F.col(f"__latest.{c}").alias(c) for c in more]) \
        .withColumn("template_version", template_version(F.col("template_text"), F.col("regex")))


def candidate_defaults(c: DataFrame, now: Column | None = None) -> DataFrame:
    """Blank version -> v0, null times -> now, blank tenant -> default."""
    now = now if now is not None else F.localtimestamp()

    def nz(x, d):
        return F.coalesce(F.nullif(F.trim(F.col(x)), F.lit("")), d)
    return (c.withColumn("template_version", nz("template_version", F.lit("v0")))
             .withColumn("tenant", nz("tenant", F.lit("default")))
             .withColumn("first_seen", F.coalesce("first_seen", now))
             .withColumn("last_seen", F.coalesce("last_seen", now)))


def validate_candidates(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Id, text and regex must be non-empty; rejects carry the first error."""
    def blank(x):
        return F.coalesce(F.length(F.col(x)), F.lit(0)) == 0
    err = (F.when(blank("template_id"), "missing template_id").when(blank("template_text"), "missing template_text")
           .when(blank("regex"), "missing regex"))
    c = c.withColumn("__err", err)
    ok = c.filter(F.col("__err").isNull()).drop("__err")
    bad = c.filter(F.col("__err").isNotNull()).select(
        F.to_json(F.struct("tenant", "template_id")).alias("source_row"), F.col("__err").alias("reason"))
    return ok, bad


def publish_ack(ok: DataFrame, rejects: DataFrame) -> DataFrame:
    """Accepted / rejected counts and the first error note (row level)."""
    a = ok.select(F.lit(1).alias("accepted"), F.lit(0).alias("rejected"), F.lit(None).cast("string").alias("note"))
    r = rejects.select(F.lit(0).alias("accepted"), F.lit(1).alias("rejected"), F.col("reason").alias("note"))
    return a.unionByName(r).agg(F.sum("accepted").cast("bigint").alias("accepted"),
                                F.sum("rejected").cast("bigint").alias("rejected"), F.min("note").alias("note"))


def fold_catalog(candidates: DataFrame, prior: DataFrame | None = None, faithful: bool = False) -> DataFrame:
    """Union prior catalog and candidates, fold per (tenant, template):
    first_seen = least, last_seen = greatest, text/regex/labels/version from the
    row with the latest last_seen. ``faithful=True`` keeps two rules of the
    upsert: a candidate whose version differs from the stored one brings its
    text whatever its last_seen, and one with an unchanged version and no newer
    last_seen does not lower first_seen."""
    cols = ["tenant", "template_id", "template_text", "regex", "labels", "first_seen", "last_seen",
            "template_version"]
    new = candidates.select(*cols, F.lit(1).alias("__src"))
    if prior is None:
        u = new
    else:
        u = prior.select(*cols, F.lit(0).alias("__src")).unionByName(new)
    changed = F.lit(0)
    if faithful and prior is not None:
        known = prior.select(*CATALOG_KEY, F.col("template_version").alias("__known"))
        u = u.join(known, CATALOG_KEY, "left")
        changed = F.when((F.col("__src") == 1) & (F.col("template_version") != F.col("__known")), 1).otherwise(0)
    latest = F.struct(changed.alias("changed"), "last_seen", "__src")
    g = u.groupBy(*CATALOG_KEY).agg(
        F.max_by("template_text", latest).alias("template_text"),
        F.max_by("regex", latest).alias("regex"),
        F.max_by("labels", latest).alias("labels"),
        F.max_by("template_version", latest).alias("template_version"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    if faithful and prior is not None:
        keep_first = prior.select(*CATALOG_KEY, F.col("first_seen").alias("__pf"),
                                  F.col("template_version").alias("__pv"), F.col("last_seen").alias("__pl"))
        g = g.join(keep_first, CATALOG_KEY, "left").withColumn(
            "first_seen", F.when((F.col("template_version") == F.col("__pv")) & (F.col("last_seen") <= F.col("__pl")),
                                 F.col("__pf")).otherwise(F.col("first_seen"))).drop("__pf", "__pv", "__pl")
    return g.select(*cols)


def rolling_stats(mined: DataFrame, as_of, windows=(("10m", 10), ("1h", 60), ("24h", 1440))) -> DataFrame:
    """A2: counts in (as_of - w, as_of] per template, long format, zero counts
    not written, updated_at = as_of."""
    m = mined.filter(~F.col("from_fallback")).withColumn("__tenant", catalog_tenant(F.col("labels")))
    a = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    aggs = [F.count(F.when((F.col("ts") > a - F.expr(f"INTERVAL {mins} MINUTES")) & (F.col("ts") <= a), 1)).alias(name)
            for name, mins in windows]
    g = m.groupBy(F.col("__tenant").alias("tenant"), "template_id").agg(*aggs)
    longf = g.select(*CATALOG_KEY, F.explode(F.array(*[
        F.struct(F.lit(name).alias("window"), F.col(name).alias("count")) for name, _ in windows])).alias("s"))
    return longf.select(*CATALOG_KEY, "s.window", "s.count", a.alias("updated_at")).filter(F.col("count") > 0)


def fold_stats(stats: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Last write wins per (tenant, template, window)."""
    u = stats if prior is None else prior.unionByName(stats)
    return u.groupBy(*CATALOG_KEY, "window").agg(
        F.max_by("count", "updated_at").alias("count"), F.max("updated_at").alias("updated_at"))


def read_current(spark, path: str) -> DataFrame | None:
    """The newest version of a table written by ``upsert_*``; None if there is none."""
    return Table(spark, path, CATALOG_KEY).read()


def upsert_catalog(path: str, candidates: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame | None:
    """U1 sink: fold candidates into the stored catalog and commit the buckets they
    touch. A batch of a named writer is folded once, however often it is sent."""
    spark = candidates.sparkSession
    Table(spark, path, CATALOG_KEY).merge(candidates, lambda old, new: fold_catalog(new, old), writer, batch)
    return read_current(spark, path)


def upsert_stats(path: str, stats: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame | None:
    """U2 sink: the last write per (tenant, template, window) wins."""
    spark = stats.sparkSession
    Table(spark, path, CATALOG_KEY).merge(stats, lambda old, new: fold_stats(new, old), writer, batch)
    return read_current(spark, path)


# ---------------------------------------------------------------- reports
def catalog_stats(catalog: DataFrame, as_of) -> DataFrame:
    """Template totals by service, by severity and overall, plus templates
    new / updated in the 24 h before ``as_of`` (GROUPING SETS)."""
    a = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    day = a - F.expr("INTERVAL 24 HOURS")
    c = catalog.select(F.col("labels")["service"].alias("service"), F.col("labels")["severity"].alias("severity"),
                       "first_seen", "last_seen")
    return c.groupingSets([["service"], ["severity"], []], "service", "severity").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("templates"),
        F.count(F.when(F.col("first_seen") > day, 1)).alias("new_24h"),
        F.count(F.when((F.col("first_seen") <= day) & (F.col("last_seen") > day), 1)).alias("updated_24h"))


def template_detail(mined: DataFrame, n_examples: int = P.EXEMPLARS_MAX) -> DataFrame:
    """A10: occurrences, active minutes, mean rate per active minute, peak
    per-minute rate, spike minutes (> 2x the template's mean per-minute rate)
    and exemplars, per template."""
    from .sampling import epoch_us
    from .templates import exemplars
    m = mined.filter(~F.col("from_fallback"))
    per_min = m.groupBy("template_id", F.floor(epoch_us() / 60_000_000).alias("minute")) \
        .agg(F.count(F.lit(1)).alias("n"))
    d = per_min.groupBy("template_id").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("active_minutes"),
        F.max("n").alias("peak_per_min"), F.avg("n").alias("mean_per_min"))
    spikes = per_min.join(d.select("template_id", "mean_per_min"), "template_id") \
        .filter(F.col("n") > 2 * F.col("mean_per_min")).groupBy("template_id") \
        .agg(F.count(F.lit(1)).alias("spike_minutes"))
    return (d.join(spikes, "template_id", "left")
             .withColumn("spike_minutes", F.coalesce("spike_minutes", F.lit(0)))
             .join(exemplars(m, n_examples), "template_id", "left"))


def period_counts(mined: DataFrame, split, key=CATALOG_KEY) -> DataFrame:
    m = mined.filter(~F.col("from_fallback")).withColumn("tenant", catalog_tenant(F.col("labels")))
    s = F.lit(split) if not isinstance(split, Column) else split
    return m.groupBy(*key).agg(F.count(F.when(F.col("ts") < s, 1)).alias("n_before"),
                               F.count(F.when(F.col("ts") >= s, 1)).alias("n_after"),
                               F.max_by("template", F.struct("ts", "log_id")).alias("template"))


def template_changes(mined: DataFrame, split) -> DataFrame:
    """Templates new after ``split`` or vanished after it (anti joins)."""
    m = mined.filter(~F.col("from_fallback")).withColumn("tenant", catalog_tenant(F.col("labels")))
    s = F.lit(split) if not isinstance(split, Column) else split
    before = m.filter(F.col("ts") < s).select(*CATALOG_KEY).distinct()
    after = m.filter(F.col("ts") >= s).select(*CATALOG_KEY).distinct()
    new = after.join(before, CATALOG_KEY, "left_anti").withColumn("change", F.lit("new"))
    gone = before.join(after, CATALOG_KEY, "left_anti").withColumn("change", F.lit("vanished"))
    return new.unionByName(gone)


def rate_delta(mined: DataFrame, split) -> DataFrame:
    """Per template counts before/after ``split``, difference and ratio."""
    c = period_counts(mined, split)
    return c.select(*CATALOG_KEY, "n_before", "n_after",
                    (F.col("n_after") - F.col("n_before")).alias("delta"),
                    F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before")).alias("ratio"))


def template_events(mined: DataFrame, split, spike_ratio: float = 2.0, spans: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Events for the batch after ``split`` against the catalog folded from
    the rows before it: NEW (no earlier row), UPDATE (version changed), SPIKE
    (rate after / rate before >= spike_ratio, rates over the lengths ``spans`` of
    the two periods, in any unit). Partition key tenant:template."""
    s = F.lit(split) if not isinstance(split, Column) else split
    prior = to_candidates(mined.filter(F.col("ts") < s))
    cur = to_candidates(mined.filter(F.col("ts") >= s))
    j = cur.alias("c").join(prior.alias("p"), CATALOG_KEY, "left")
    et = (F.when(F.col("p.template_version").isNull(), "NEW")
          .when(F.col("p.template_version") != F.col("c.template_version"), "UPDATE")
          .when(F.col("c.n") * F.lit(float(spans[0])) >= F.lit(spike_ratio) * F.col("p.n") * F.lit(float(spans[1])), "SPIKE"))
    return j.select(*CATALOG_KEY, et.alias("event_type"), F.col("c.n").alias("n_after"),
                    F.col("p.n").alias("n_before"),
                    F.concat_ws(":", "tenant", "template_id").alias("partition_key")) \
        .filter(F.col("event_type").isNotNull())
