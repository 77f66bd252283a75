"""Job 3: normalized_logs -> mined_logs, template_memory.

Skew notes: every per-template aggregate is a hash aggregate with map-side
partial aggregation, so a template holding a third of all rows costs one
partial row per map task. The first occurrence is found by ``min(struct)``
(partial-aggregated), never by a window over the whole template. Exemplar
top-n uses ``row_number() <= n``, which Spark plans with a partial
WindowGroupLimit before the shuffle (at most n rows per template per map
task cross the network).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.templates import group_signature, mask, template_id, template_regex, token_seq
from .normalize import unicode_trim

FALLBACK_MISSING = "missing"


def with_templates(df: DataFrame, preset: str = "basic", regex_profile: str = "code",
                   message_col: str = "message") -> DataFrame:
    """M2 + M5 + M6 + M8 (+ M9) on each row; null and blank messages get the J1 fallback."""
    m = F.col(message_col)
    blank = F.length(unicode_trim(F.coalesce(m, F.lit("")))) == 0
    tmpl = mask(m, preset)
    df = df.withColumn("__blank", blank).withColumn("template", F.when(~blank, tmpl))
    return (df.withColumn("template_id", F.when(F.col("__blank"), F.lit(FALLBACK_MISSING))
                          .otherwise(template_id(F.col("template"))))
              .withColumn("regex", F.when(F.col("__blank"), F.lit(".*"))
                          .otherwise(template_regex(F.col("template"), regex_profile)))
              .withColumn("group_signature", group_signature(m))
              .withColumn("token_seq", token_seq(m))
              .withColumn("from_fallback", F.col("__blank"))
              .drop("__blank"))


def first_occurrence(df: DataFrame, key: list[str], order: list[str] = ("ts", "log_id")) -> DataFrame:
    """Per key: the (ts, log_id) of its first row, via partial-aggregated min."""
    first = F.min(F.struct(*[F.col(c) for c in order])).alias("__first")
    return df.groupBy(*key).agg(first, F.min("ts").alias("first_seen"),
                                F.max("ts").alias("last_seen"))


def with_provenance(df: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """M10 + M11: first row of a template -> HEURISTIC, confidence 0.5; later
    rows (or templates already in ``prior`` memory) -> CACHE, 0.9. Fallback
    rows -> FALLBACK, 0."""
    firsts = first_occurrence(df.filter(~F.col("from_fallback")), ["template_id"])
    firsts = firsts.select("template_id", F.col("__first.ts").alias("ts"), F.col("__first.log_id").alias("log_id"))
    if prior is not None:
        firsts = firsts.join(prior.select("template_id"), "template_id", "left_anti")
    # Joined on the first row itself, not on the template, so a template with
    # many rows is spread over all tasks.
    from .ordered import null_safe_join
    out = null_safe_join(df, firsts.withColumn("__is_first", F.lit(True)), ["template_id", "ts", "log_id"], "left")
    is_first = F.coalesce(F.col("__is_first"), F.lit(False)) & ~F.col("from_fallback")
    out = (out.withColumn("provenance", F.when(F.col("from_fallback"), "FALLBACK")
                          .when(is_first, "HEURISTIC").otherwise("CACHE"))
              .withColumn("confidence", F.when(F.col("from_fallback"), F.lit(0.0))
                          .when(is_first, F.lit(P.CONFIDENCE_NEW)).otherwise(F.lit(P.CONFIDENCE_MATCH))
                          .cast("float")))
    return out.drop("__is_first")


def materialize(df: DataFrame) -> DataFrame:
    """Persist a per-row intermediate that several branches consume (aggregate
    + join-back), so its regex work runs once. MEMORY_AND_DISK: partitions
    lost with an executor are recomputed from lineage."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def mine(df: DataFrame, preset: str = "basic", regex_profile: str = "code",
         prior: DataFrame | None = None, persist: bool = True) -> DataFrame:
    """Job 3 in mask mode: templates + provenance + confidence per row."""
    t = with_templates(df, preset, regex_profile)
    return with_provenance(materialize(t) if persist else t, prior)


def exemplars(df: DataFrame, n: int = P.EXEMPLARS_MAX, key: str = "template_id",
              message_col: str = "message") -> DataFrame:
    """The ``n`` newest messages per template (newest first)."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("log_id").desc())
    top = df.select(key, "ts", "log_id", message_col).withColumn("__rn", F.row_number().over(w)) \
        .filter(F.col("__rn") <= n)
    return top.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__rn", message_col))),
                    lambda s: s[message_col]).alias("examples"))


def template_memory(df: DataFrame, prior: DataFrame | None = None, n_examples: int = P.EXEMPLARS_MAX, persist: bool = True) -> DataFrame:
    """M12 + M13: per template text, regex, first/last seen, count, exemplars.
    With ``prior`` memory the fold keeps the earliest first_seen, latest
    last_seen, summed counts and the newest exemplars of both."""
    # Persist first, then filter: a filter on a column derived from the
    # redaction output placed below the persist doubled the stage's cost.
    mined = (materialize(df) if persist else df).filter(~F.col("from_fallback"))  # aggregate + exemplar branches
    agg = mined.groupBy("template_id").agg(
        F.first("template", ignorenulls=True).alias("template"),
        F.first("regex", ignorenulls=True).alias("regex"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("n"))
    mem = agg.join(exemplars(mined, n_examples), "template_id", "left")
    if prior is None:
        return mem
    u = mem.unionByName(prior.select(*mem.columns))
    return u.groupBy("template_id").agg(
        F.max_by("template", "last_seen").alias("template"), F.max_by("regex", "last_seen").alias("regex"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("n").alias("n"),
        F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("last_seen", "examples")), False),
                                      lambda s: s["examples"])), 1, n_examples).alias("examples"))


SHADOW_TYPE = "array<struct<template_id:string,template:string,regex:string,confidence:float>>"


def shadows(df: DataFrame) -> DataFrame:
    """When the primary template differs from the masked text, the masked
    text is an alternate with confidence 0.3."""
    masked = mask(F.col("message"))
    alt = F.struct(template_id(masked).alias("template_id"), masked.alias("template"),
                   template_regex(masked).alias("regex"),
                   F.lit(P.CONFIDENCE_SHADOW).cast("float").alias("confidence"))
    return df.withColumn("shadows", F.when(F.col("template") != masked, F.array(alt))
                         .otherwise(F.array().cast(SHADOW_TYPE)))


def mine_distinct(df: DataFrame, miner, key: list[str] = ("tenant",), message_col: str = "message") -> DataFrame:
    """Run ``miner`` (a DataFrame -> DataFrame template function) once per
    distinct (key, masked signature) instead of once per row, then join back."""
    sig = F.sha1(mask(F.col(message_col)))
    keyed = df.withColumn("__sig", sig)
    reps = keyed.groupBy(*key, "__sig").agg(F.min(F.struct("ts", "log_id", message_col)).alias("__rep"))
    reps = reps.select(*key, "__sig", F.col(f"__rep.{message_col}").alias(message_col))
    mined = miner(reps).drop(message_col)
    from .ordered import null_safe_join
    return null_safe_join(keyed, mined, [*key, "__sig"], "left").drop("__sig")


def _entries(keys: list[str], ttl_us: int):
    """Start of the cache entry that serves each time, for times that come signature by signature, in order:
    an entry serves ``ttl_us`` from the time that made it, and the first time after that makes the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = None, 0
        for batch in batches:
            us = batch.column("__us").to_numpy()
            ids = list(zip(*(batch.column(c).to_pylist() for c in keys), strict=True))
            out = np.empty(len(us), dtype=np.int64)
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi and ids[lo] != own:
                    own, start = ids[lo], int(us[lo])
                while lo < hi:
                    if us[lo] >= start + ttl_us:
                        start = int(us[lo])
                    end = lo + int(np.searchsorted(us[lo:hi], start + ttl_us))
                    out[lo:end] = start
                    lo = end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "__entry"])
    return run


def mine_cached(df: DataFrame, miner, ttl: str = "1 hour", key: list[str] = ("tenant",), message_col: str = "message") -> DataFrame:
    """Like ``mine_distinct``, with a cache that forgets: a masked signature is mined for its
    first record, the result serves records of the next ``ttl``, and the first one after that
    mines again. Adds the miner's columns and ``cached`` (false for the record that was mined).

    Times of a signature are reduced to distinct ones first and streamed in order,
    so no signature is gathered. Records without a time share one entry per signature."""
    from .ordered import null_safe_join
    from .sampling import epoch_us
    keys = [*key, "__sig"]
    keyed = materialize(df.withColumn("__sig", F.sha1(mask(F.coalesce(F.col(message_col), F.lit(""))))).withColumn("__us", epoch_us()))
    times = keyed.where(F.col("ts").isNotNull()).select(*keys, "__us").distinct().repartition(*keys).sortWithinPartitions(*keys, "__us")
    kinds = T.StructType([*times.schema.fields, T.StructField("__entry", T.LongType())])
    rows = null_safe_join(keyed, times.mapInArrow(_entries(keys, pd.Timedelta(ttl).value // 1000), kinds), [*keys, "__us"], "left").drop("__us")
    reps = rows.groupBy(*keys, "__entry").agg(F.min(F.struct("ts", "log_id", message_col)).alias("__rep"))
    mined = miner(reps.select(*keys, "__entry", F.col("__rep.log_id").alias("__call"), F.col(f"__rep.{message_col}").alias(message_col))).drop(message_col)
    out = null_safe_join(rows, mined, [*keys, "__entry"], "left")
    return out.withColumn("cached", ~F.col("log_id").eqNullSafe(F.col("__call"))).drop("__sig", "__entry", "__call")


def grouping_buckets(df: DataFrame, ttl: str = "5 minutes", key: str = "tenant",
                     n_examples: int = 3) -> DataFrame:
    """Per tenant + masked text, session buckets with a ``ttl`` gap: size,
    first/last seen and the first ``n_examples`` messages.

    Sessionization runs on a per-(key, masked, second) rollup (partial
    aggregated, so a hot group costs one row per second, not per record);
    exemplars come from the bucket's earliest rows through a bounded
    row_number <= n (partial WindowGroupLimit before the shuffle).
    """
    s = df.withColumn("masked", mask(F.col("message"))).withColumn(
        "__sec", F.date_trunc("second", F.col("ts")))
    roll = s.groupBy(key, "masked", "__sec").agg(F.count(F.lit(1)).alias("__n"), F.min("ts").alias("__begin"),
                                                 F.max("ts").alias("__last"))
    gap = F.expr(f"INTERVAL {ttl}")
    w = Window.partitionBy(key, "masked").orderBy("__sec")
    roll = roll.withColumn("__new", F.coalesce(F.lag("__last").over(w) + gap < F.col("__begin"), F.lit(True)))
    roll = roll.withColumn("bucket", F.sum(F.col("__new").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    buckets = roll.groupBy(key, "masked", "bucket").agg(
        F.sum("__n").alias("size"), F.min("__begin").alias("first_seen"), F.max("__last").alias("last_seen"))
    from .ordered import null_safe_join
    rows = null_safe_join(s, roll.select(key, "masked", "__sec", "bucket"), [key, "masked", "__sec"])
    wr = Window.partitionBy(key, "masked", "bucket").orderBy("ts", "log_id")
    ex = (rows.withColumn("__rn", F.row_number().over(wr)).filter(F.col("__rn") <= n_examples)
              .groupBy(key, "masked", "bucket")
              .agg(F.transform(F.sort_array(F.collect_list(F.struct("__rn", "message"))),
                               lambda x: x["message"]).alias("exemplars")))
    return null_safe_join(buckets, ex, [key, "masked", "bucket"], "left")


def refine_budget(df: DataFrame, qpm: int = 60, key: str = "tenant") -> DataFrame:
    """At most ``qpm`` refinements per tenant per minute (first by ts, log_id)."""
    from .ordered import running_sum
    d = running_sum(df.withColumn("__min", F.date_trunc("minute", F.col("ts"))), [key, "__min"], None, "__pos")
    return d.withColumn("refine_allowed", F.col("__pos") <= qpm).drop("__min", "__pos")


# ---------------------------------------------------------------- M19-M23
def token_hamming(a: Column, b: Column) -> Column:
    ta, tb = F.split(a, " "), F.split(b, " ")
    same_len = F.size(ta) == F.size(tb)
    diff = F.aggregate(F.zip_with(ta, tb, lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0),
                       lambda acc, x: acc + x)
    return F.when(same_len, diff)


def template_similarity(pairs: DataFrame, a: str = "template_a", b: str = "template_b") -> DataFrame:
    """Normalized edit distance, token Jaccard and token Hamming per pair."""
    ca, cb = F.col(a), F.col(b)
    ta, tb = F.array_distinct(F.split(ca, " ")), F.array_distinct(F.split(cb, " "))
    return pairs.select("*",
                        (F.levenshtein(ca, cb) / F.greatest(F.length(ca), F.length(cb), F.lit(1))).alias("edit_norm"),
                        (F.size(F.array_intersect(ta, tb)) / F.size(F.array_union(ta, tb))).alias("jaccard"),
                        token_hamming(ca, cb).alias("hamming"))


def hamming_neighbors(templates: DataFrame, context: list[str] = ("tenant",), max_hamming: int = 1) -> DataFrame:
    """Pairs of templates with the same context and token count whose tokens
    differ in at most ``max_hamming`` positions.

    Exact without emitting all pairs: two templates with Hamming <= 1 share
    every token but one, so they agree on the key made by blanking one token
    position. We emit one key per (template, position) and equi-join on it.
    """
    toks = F.split(F.col("template"), " ")
    t = templates.select(*context, "template_id", "template", F.size(toks).alias("__n"), toks.alias("__toks"))
    blanked = t.select(*context, "template_id", "__n",
                       F.posexplode(F.transform(F.col("__toks"), lambda _, i: F.array_join(
                           F.concat(F.slice(F.col("__toks"), 1, i), F.array(F.lit("\u0000")),
                                    F.slice(F.col("__toks"), i + 2, 1 << 20)), " "))).alias("__pos", "__key"))
    a = blanked.alias("a")
    b = blanked.alias("b")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in context] + [
        F.col("a.__n") == F.col("b.__n"), F.col("a.__pos") == F.col("b.__pos"),
        F.col("a.__key") == F.col("b.__key"), F.col("a.template_id") < F.col("b.template_id")]
    pairs = a.join(b, cond).select(*[F.col(f"a.{c}") for c in context],
                                   F.col("a.template_id").alias("id_a"), F.col("b.template_id").alias("id_b"))
    return pairs.distinct()


def _blanked(templates: DataFrame, context: list[str]) -> DataFrame:
    """One fixed-length key per template and token position: the tokens with that one blanked."""
    toks = F.split(F.col("template"), " ")
    t = templates.select(*context, "template_id", toks.alias("__toks"))
    return t.select(*context, "template_id", F.size("__toks").alias("__n"), F.posexplode(F.transform(
        "__toks", lambda _, i: F.md5(F.array_join(F.concat(F.slice("__toks", F.lit(1), i), F.array(F.lit("\u0000")), F.slice(
            "__toks", i + 2, F.size("__toks"))), " ")))).alias("__pos", "__key"))


def merge_templates(templates: DataFrame, context: list[str] = ("tenant",)) -> DataFrame:
    """Connected components of the Hamming<=1 graph; canonical id = the
    smallest template id in the component.

    All templates of a blanked key are linked to the smallest of them, which
    connects the same templates as all their pairs would with a link per
    template and key; components are found by star contraction to the end.
    """
    from .components import components
    from .ordered import null_safe_join
    context = list(context)
    keys = _blanked(templates, context)
    group = [*context, "__n", "__pos", "__key"]
    hub = keys.groupBy(*group).agg(F.min("template_id").alias("hub"))
    node = lambda c: F.struct(*context, F.col(c).alias("template_id"))
    edges = null_safe_join(keys, hub, group).where("template_id != hub").select(node("template_id").alias("a"), node("hub").alias("b"))
    found = components(edges).select(*[F.col(f"node.{c}").alias(c) for c in (*context, "template_id")],
                                     F.col("component.template_id").alias("canonical_id"))
    out = null_safe_join(templates, found, [*context, "template_id"], "left")
    return out.withColumn("canonical_id", F.coalesce("canonical_id", "template_id"))


def split_candidates(mined: DataFrame, limit: int = 50) -> DataFrame:
    """Per template and wildcard position, number of distinct raw tokens;
    positions above ``limit`` are split candidates."""
    t = mined.select("template_id", F.split("template", " ").alias("tt"), F.split("message", " ").alias("mt"))
    t = t.filter(F.size("tt") == F.size("mt"))
    z = t.select("template_id", F.posexplode(F.arrays_zip("tt", "mt")).alias("pos", "z"))
    z = z.filter(F.col("z.tt").rlike("^<[^<>]+>$"))
    z = z.groupBy("template_id", "pos", "z.mt").agg(F.count(F.lit(1)).alias("n"))  # a hot position's tokens are counted apart
    return (z.groupBy("template_id", "pos").agg(F.count(F.lit(1)).alias("distinct_values"))
             .withColumn("split", F.col("distinct_values") > limit))


def template_drift(mined: DataFrame, leaf: Column | None = None) -> DataFrame:
    """Per leaf (token count + first token), templates in order of first_seen."""
    leaf = leaf if leaf is not None else F.concat_ws(
        ":", F.size(F.split("template", " ")).cast("string"), F.split("template", " ")[0])
    f = mined.groupBy(leaf.alias("leaf"), "template_id").agg(F.min("ts").alias("first_seen"))
    w = Window.partitionBy("leaf").orderBy("first_seen", "template_id")
    return f.withColumn("version", F.row_number().over(w))


def apply_custom_templates(df: DataFrame, rules: list[dict], message_col: str = "message") -> DataFrame:
    """User rules ``{rule_id, priority, pattern (RE2), template}`` override
    mined templates. Rules are configuration (bounded, checked by
    ``MAX_CUSTOM_RULES``), so they compile into one CASE expression evaluated
    per row: no join, no shuffle. Highest priority wins, then rule_id."""
    if len(rules) > MAX_CUSTOM_RULES:
        raise ValueError(f"{len(rules)} custom rules exceed the bound {MAX_CUSTOM_RULES}")
    ordered = sorted(rules, key=lambda r: (-r.get("priority", 0), str(r["rule_id"])))
    m = F.col(message_col)
    tmpl = F.when(F.lit(False), F.lit(None))
    rid = F.when(F.lit(False), F.lit(None))
    for r in ordered:
        hit = m.rlike(P.to_java(r["pattern"]))
        tmpl = tmpl.when(hit, F.lit(r["template"]))
        rid = rid.when(hit, F.lit(str(r["rule_id"])))
    out = df.withColumn("custom_rule", rid)
    out = out.withColumn("template", F.coalesce(tmpl, F.col("template")))
    out = out.withColumn("template_id", F.when(F.col("custom_rule").isNotNull(), template_id(F.col("template")))
                         .otherwise(F.col("template_id")))
    return out.withColumn("regex", F.when(F.col("custom_rule").isNotNull(), template_regex(F.col("template")))
                          .otherwise(F.col("regex")))


MAX_CUSTOM_RULES = 10_000


def align(left: DataFrame, right: DataFrame, on: str = "log_id", fallback: dict | None = None) -> DataFrame:
    """Left outer join results onto inputs; duplicate results keep the
    last one (max ``seq``); absent results take ``fallback`` values."""
    if "seq" in right.columns:
        cols = [c for c in right.columns if c not in (on, "seq")]
        right = right.groupBy(on).agg(*[F.max_by(c, "seq").alias(c) for c in cols])
    out = left.join(right, on, "left")
    for c, v in (fallback or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    return out
