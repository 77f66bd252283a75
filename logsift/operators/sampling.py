"""Job 4: mined_logs -> decided_logs.

Counters (batch). Order within a sampler key is (ts, log_id). Instead of one
window over the whole key (a hot key would land in one task), we:

1. roll up rows per (key, second) with partial aggregation;
2. compute prefix sums, range-window counts and the EMA on that small rollup
   (partitioned by key, sorted once: one row per occupied second);
3. join the rollup back on (key, second) and add the rank inside the second.

The big side is shuffled once, by (key, second), and both the join and the
in-second rank reuse that partitioning.

EMA. The per-record recursion ``ema = a*cur_min + (1-a)*ema`` has a closed
form inside a minute: with r = 1-a, E0 the value entering the minute and j
the in-minute count, ``E_j = r^j*E0 + j - (r/a)*(1 - r^j)``. E0 per minute is
a sequential scan of the sorted rollup that holds one key's average; the
per-record value is then a column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from .ordered import null_safe_join
from .templates import materialize

def epoch_us(c: str = "ts") -> Column:
    """Microseconds since the epoch of a wall-clock (UTC) timestamp; independent
    of the session time zone for TIMESTAMP_NTZ input."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")

KEY = ["key_tenant", "template_id", "key_service", "key_env", "severity"]
WINDOWS = [(10, "count_10m"), (60, "count_1h"), (1440, "count_24h")]


def ema_alpha(half_life: float) -> float:
    return 0.2 if half_life <= 0 else 1.0 - 0.5 ** (1.0 / half_life)


@dataclass(frozen=True)
class Policy:
    """Sampling ladder settings (defaults of the reference sampler)."""
    severity_keep: tuple = ("ERROR", "FATAL")
    novelty: bool = True
    warmup_n: int = P.WARMUP_N
    log2: bool = P.LOG2_ENABLED
    steady_k: dict = field(default_factory=lambda: dict(P.STEADY_K))
    steady_k_other: int = P.STEADY_K_OTHER
    spike_factor: float = P.SPIKE_FACTOR
    min_spike: int = P.MIN_SPIKE_PER_MIN
    half_life: float = P.EMA_HALF_LIFE_MIN
    budget_10m: int = P.BUDGET_10M
    version: str = P.POLICY_VERSION
    novelty_hours: float = 0.0  # above 0: a key stays novel for so long after its first record


#: Thresholds a table of policies may set per tenant, as columns ``pol_<name>``.
TENANT_THRESHOLDS = ("warmup_n", "min_spike", "spike_factor", "budget_10m")


def with_key(df: DataFrame) -> DataFrame:
    """Sampler key: tenant (blank -> default), template, service and env
    (blank -> '-'), severity."""
    def nz(c, d):
        return F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(d))
    return (df.withColumn("key_tenant", nz("tenant", "default"))
              .withColumn("key_service", nz("service", "-"))
              .withColumn("key_env", nz("env", "-")))


def minute_rollup(df: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A1: rows per (key, minute)."""
    return (df.withColumn("minute", F.floor(epoch_us() / 60_000_000))
              .groupBy(*key, "minute").agg(F.count(F.lit(1)).alias("n")))


def ema_per_minute(df: DataFrame, alpha: float = 0.2, key: list[str] = KEY) -> DataFrame:
    """Per key and minute with records, the moving average of records per
    minute before it; minutes without records count as 0. Streams over sorted
    partitions of the minute rollup, and holds one key's average."""
    roll = minute_rollup(with_key(df), key).filter(F.col("minute").isNotNull())
    roll = roll.repartition(*key).sortWithinPartitions(*key, "minute")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, e = None, 0, 0.0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*key, "minute", "n")), strict=True):
                own, minute, n = row[:-2], row[-2], row[-1]
                before = e * (1 - alpha) ** (minute - at - 1) if own == last else 0.0
                out.append(before)
                last, at, e = own, minute, alpha * n + (1 - alpha) * before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "baseline"])

    return roll.mapInArrow(run, T.StructType([*roll.schema.fields, T.StructField("baseline", T.DoubleType())]))


def entering_average(alpha: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """E0 of each second of a rollup that comes key by key, in order: the EMA value before the first
    record of its minute. ``__before`` is 0 at a key's first second, and ``__before_minute`` counts
    the key's records before the minute, so only the average at hand is kept between batches."""
    r = 1.0 - alpha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, counted, at = 0.0, 0, -1
        for batch in batches:
            out = np.empty(0)
            if batch.num_rows:
                before, upto, minute = (batch.column(c).to_numpy() for c in ("__before", "__before_minute", "cur_minute"))
                opens = before == 0
                new = opens | (minute != np.concatenate(([at], minute[:-1])))
                first, upto = opens[new], upto[new]
                # Records of the minute before; a key's first minute has none.
                ks = np.where(first, 0, upto - np.concatenate(([counted], upto[:-1]))).astype(np.float64)
                rk = np.power(r, ks)
                add = ks - (r / alpha) * (1.0 - rk)
                own = [e]
                for is_first, x, y in zip(first.tolist(), rk.tolist(), add.tolist(), strict=True):
                    e = 0.0 if is_first else x * e + y
                    own.append(e)
                out = np.array(own)[np.cumsum(new)]
                counted, at = int(upto[-1]) if len(upto) else counted, int(minute[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "e0"])
    return run


def with_counters(df: DataFrame, policy: Policy = Policy(), inclusive: bool = True,
                  key: list[str] = KEY, ema: bool = True) -> DataFrame:
    """Seq (running total), cur_min, count_10m/1h/24h, key_first_seen, ema."""
    us = epoch_us()
    df = materialize(df.withColumn("__sec", F.floor(us / 1_000_000)).withColumn("cur_minute", F.floor(us / 60_000_000)))
    # A row without a time has no place in the order: it keeps null counters.
    untimed, df = df.filter(F.col("ts").isNull()).drop("__sec"), df.filter(F.col("ts").isNotNull())
    # One column that is never null and equal where all key columns are equal or both null,
    # so that the rollup, its windows, the join and the rank share their partitioning.
    df = df.withColumn("__key", F.struct(*key))
    # The rollup is combined before its shuffle; the rows themselves are
    # shuffled once, by (key, second), for the join-back and the in-second rank.
    roll = df.groupBy("__key", "__sec").agg(F.count(F.lit(1)).alias("__c"), F.min("ts").alias("__mints"))
    roll = roll.withColumn("cur_minute", F.floor(F.col("__sec") / 60))
    # Sorted by minute and second, the rollup is in order for the windows over minutes, too.
    wk = Window.partitionBy("__key").orderBy("cur_minute", "__sec")
    wmin = Window.partitionBy("__key").orderBy("cur_minute")
    roll = (roll.withColumn("__before", F.coalesce(F.sum("__c").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .withColumn("key_first_seen", F.min("__mints").over(wk.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("__before_minute", F.coalesce(F.sum("__c").over(
                    wmin.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    for n, name in WINDOWS:
        span = n + 1 if inclusive else n
        roll = roll.withColumn(f"__out_{name}", F.coalesce(F.sum("__c").over(
            wmin.rangeBetween(Window.unboundedPreceding, -span)), F.lit(0)))
    roll = roll.drop("__mints", "__c")
    alpha = ema_alpha(policy.half_life)
    if ema:
        # The windows leave each key in one partition.
        roll = roll.sortWithinPartitions("__key", "cur_minute", "__sec").mapInArrow(
            entering_average(alpha), T.StructType([*roll.schema.fields, T.StructField("e0", T.DoubleType())]))
    # Merged, as by the size of its files a table may pass for one to broadcast when its rows are many times that.
    rows = df.join(roll.drop("cur_minute").hint("merge"), ["__key", "__sec"])
    # The key columns are named, too, so that a filter on them is applied before the join.
    ws = Window.partitionBy("__key", "__sec", *key).orderBy("ts", "log_id")
    rows = rows.withColumn("__rank", F.row_number().over(ws))
    rows = (rows.withColumn("seq", (F.col("__before") + F.col("__rank")).cast("bigint"))
                .withColumn("cur_min", (F.col("__before") - F.col("__before_minute") + F.col("__rank")).cast("bigint")))
    for _, name in WINDOWS:
        rows = rows.withColumn(name, (F.col("seq") - F.col(f"__out_{name}")).cast("bigint"))
    if ema:
        r = 1.0 - alpha
        j = F.col("cur_min").cast("double")
        rj = F.pow(F.lit(r), j)
        rows = rows.withColumn("ema", rj * F.col("e0") + j - F.lit(r / alpha) * (F.lit(1.0) - rj))
    rows = rows.drop("__key", "__sec", "__rank", "__before", "__before_minute", "e0",
                     *[f"__out_{n}" for _, n in WINDOWS])
    return rows.unionByName(untimed, allowMissingColumns=True)


def steady_k(policy: Policy, sev: Column) -> Column:
    e = F.when(F.lit(False), F.lit(None))
    for s, k in policy.steady_k.items():
        e = e.when(sev == s, F.lit(k if k else policy.steady_k_other))
    return e.otherwise(F.lit(policy.steady_k_other)).cast("bigint")


def ladder(policy: Policy = Policy(), per_tenant: tuple[str, ...] = (), k: Column | None = None) -> Column:
    """First matching rung wins -> struct(action, keep_reason, sample_rate, note).
    Thresholds named in ``per_tenant`` come from their ``pol_`` columns where
    those are set (W20); ``k`` is the steady rate, by default that of the policy."""
    limit = {n: F.coalesce(F.col(f"pol_{n}"), F.lit(getattr(policy, n))) if n in per_tenant else F.lit(getattr(policy, n))
             for n in TENANT_THRESHOLDS}
    sev, total, cur, ema = F.col("severity"), F.col("seq"), F.col("cur_min"), F.col("ema")
    k = steady_k(policy, sev) if k is None else k

    def d(action, reason, rate, note):
        return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("keep_reason"),
                        F.lit(rate).cast("bigint").alias("sample_rate") if not isinstance(rate, Column)
                        else rate.cast("bigint").alias("sample_rate"),
                        (note if isinstance(note, Column) else F.lit(note)).alias("note"))

    e = F.when(sev.isin(*policy.severity_keep), d("KEEP", "SEVERITY", 1, ""))
    if policy.novelty:
        e = e.when(total <= 1, d("KEEP", "NOVEL", 1, "first-occurrence"))
    if policy.novelty_hours > 0:
        age = epoch_us("ts") - epoch_us("key_first_seen")
        e = e.when(age < policy.novelty_hours * 3.6e9, d("KEEP", "NOVEL", 1, "recent"))
    e = e.when((ema > 0) & (cur >= limit["spike_factor"] * ema) & (cur >= limit["min_spike"]),
               d("KEEP", "SPIKE", 1, F.format_string("cur=%d ema=%.2f", cur, ema)))
    e = e.when(total <= limit["warmup_n"], d("KEEP", "WARMUP", 1, F.format_string("n=%d/%d", total, limit["warmup_n"])))
    if policy.log2:
        e = e.when((total > 0) & (F.expr("seq & (seq - 1)") == 0),
                   d("KEEP", "LOG2", 1, F.format_string("n=%d", total)))
    if policy.budget_10m > 0 or "budget_10m" in per_tenant:
        over = (limit["budget_10m"] > 0) & (F.col("count_10m") > limit["budget_10m"]) & sev.isin("DEBUG", "INFO")
        note = F.format_string("budget>10m: %d>%d", F.col("count_10m"), limit["budget_10m"])
        e = e.when(over & (F.pmod(total, k) == 0), d("KEEP", "BUDGET", k, note))
        e = e.when(over, d("SUPPRESS", "BUDGET", k, note))
    e = e.when(F.pmod(total, k) == 0, d("KEEP", "STEADYK", k, ""))
    # No counters (no time): the fallback, as when the sampler cannot be asked.
    return F.when(total.isNull(), d("KEEP", "WARMUP", 1, "")).otherwise(e.otherwise(d("SUPPRESS", "STEADYK", k, "")))


def decide(mined: DataFrame, policy: Policy = Policy(), inclusive: bool = True,
           policies: DataFrame | None = None, max_qps: float | None = None) -> DataFrame:
    """Counters + ladder; one decision per record (flat columns + struct).
    ``policies`` (key_tenant and any of ``TENANT_THRESHOLDS``) sets thresholds per tenant; with
    ``max_qps``, DEBUG and INFO records of a tenant over its budget in a second are kept at the raised rate of ``budget_k`` (W18)."""
    if max_qps is not None:
        mined = budget_k(with_key(mined), max_qps, policy)
    return with_decision(with_counters(with_key(mined), policy, inclusive), policy, policies)


def with_decision(df: DataFrame, policy: Policy = Policy(), policies: DataFrame | None = None) -> DataFrame:
    """The ladder over rows that have counters, whether a batch or a stream counted them; a
    column ``k_eff`` is the steady rate where there is one."""
    own: tuple[str, ...] = ()
    if policies is not None:
        own = tuple(n for n in TENANT_THRESHOLDS if n in policies.columns)
        df = join_policies(df, policies.select("key_tenant", *[F.col(n).alias(f"pol_{n}") for n in own]))
    k = F.col("k_eff").cast("bigint") if "k_eff" in df.columns else None
    df = df.withColumn("__d", ladder(policy, own, k)).drop(*[f"pol_{n}" for n in own])
    df = (df.withColumn("action", F.col("__d.action")).withColumn("keep_reason", F.col("__d.keep_reason"))
            .withColumn("sample_rate", F.col("__d.sample_rate")).withColumn("note", F.col("__d.note"))
            .withColumn("policy_version", F.when(F.col("seq").isNull(), F.lit(P.FALLBACK_POLICY_VERSION))
                        .otherwise(F.lit(policy.version))).drop("__d"))
    return df.withColumn("decision", F.struct(
        "action", "keep_reason",
        F.struct("count_10m", "count_1h", "count_24h").alias("counters"),
        "sample_rate", "policy_version", "note"))


def fallback_decision() -> Column:
    """KEEP/WARMUP, rate 1, version 'fallback'."""
    return F.struct(F.lit("KEEP").alias("action"), F.lit("WARMUP").alias("keep_reason"),
                    F.lit(1).cast("bigint").alias("sample_rate"),
                    F.lit(P.FALLBACK_POLICY_VERSION).alias("policy_version"))


@dataclass(frozen=True)
class Enforcement:
    debug: bool = True
    info: bool = False
    warn: bool = False
    error: bool = False
    by_namespace: dict = field(default_factory=dict)


def enforce(df: DataFrame, flags: Enforcement = Enforcement()) -> DataFrame:
    """Enforced flag by severity (fatal always), else namespace override
    (``k8s_namespace`` or ``namespace`` label), else off."""
    sev = F.col("severity")
    e = F.when(sev == "FATAL", True)
    for s, on in (("DEBUG", flags.debug), ("INFO", flags.info), ("WARN", flags.warn), ("ERROR", flags.error)):
        if on:
            e = e.when(sev == s, True)
    for k, v in flags.by_namespace.items():  # without any, labels are not read
        e = e.when(F.coalesce(F.col("labels")["k8s_namespace"], F.col("labels")["namespace"]) == k, bool(v))
    return df.withColumn("enforced", e.otherwise(False))


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Enforced & SUPPRESS -> suppressed; not enforced -> kept with
    shadow=true; else kept. Two complementary filters over one frame."""
    sup = F.col("enforced") & (F.col("action") == "SUPPRESS")
    kept = df.filter(~sup).withColumn("shadow", ~F.col("enforced"))
    return kept, df.filter(sup)


# ---------------------------------------------------------------- W16-W20, W23
def keep_incident(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """Flag rows whose trace id is in an active incident interval.
    Incidents are a small, size-checked table; the join is an equi-join on
    trace id with a range condition, never a cross product."""
    from ..plans.guards import checked_broadcast
    inc = incidents.select("trace_id", F.col("start").alias("__s"), F.col("end").alias("__e"))
    b = checked_broadcast(inc, "incidents")
    inc = b if b is not None else inc
    tid = F.col("correlation_id")
    hit = df.select("log_id", tid.alias("trace_id"), "ts").join(inc, "trace_id") \
        .filter((F.col("ts") >= F.col("__s")) & (F.col("ts") <= F.col("__e"))) \
        .select("log_id").distinct().withColumn("incident", F.lit(True))
    return df.join(hit, "log_id", "left").withColumn("incident", F.coalesce("incident", F.lit(False)))


def p95_spikes(df: DataFrame, window_minutes: int = 10, factor: float = 2.0, key: list[str] = KEY) -> DataFrame:
    """Per key and minute, flag minutes whose count exceeds factor x the
    p95 of the preceding ``window_minutes`` minute counts (idle minutes inside
    the key's active range count as 0)."""
    roll = minute_rollup(with_key(df), key).filter(F.col("minute").isNotNull())
    w = Window.partitionBy(*key).orderBy("minute")
    # At most one value per minute of the window is gathered.
    roll = (roll.withColumn("__seen", F.sort_array(F.collect_list("n").over(w.rangeBetween(-window_minutes, -1))))
                .withColumn("__first", F.min("minute").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    minutes = F.least(F.lit(window_minutes), F.col("minute") - F.col("__first"))
    # The smallest count that covers 95 % of the minutes; idle minutes come first, as 0.
    at = F.ceil(minutes * 0.95) - (minutes - F.size("__seen"))
    p95 = F.when(minutes > 0, F.when(at <= 0, F.lit(0).cast("bigint")).otherwise(F.get("__seen", (at - 1).cast("int"))))
    return roll.withColumn("p95", p95).drop("__seen", "__first").withColumn(
        "spike", F.col("p95").isNotNull() & (F.col("n") > F.lit(factor) * F.col("p95")))


def budget_k(df: DataFrame, max_qps: float, policy: Policy = Policy(), key: str = "key_tenant") -> DataFrame:
    """Tenants above max_qps in a second get k_eff = k * ceil(qps / max_qps)
    for DEBUG/INFO."""
    sec = F.floor(epoch_us() / 1_000_000)
    qps = df.groupBy(key, sec.alias("__s")).agg(F.count(F.lit(1)).alias("qps"))
    out = null_safe_join(df.withColumn("__s", sec), qps, [key, "__s"], "left").drop("__s")
    k = steady_k(policy, F.col("severity"))
    mult = F.greatest(F.lit(1), F.ceil(F.col("qps") / F.lit(max_qps)))
    return out.withColumn("k_eff", F.when(F.col("severity").isin("DEBUG", "INFO"), k * mult).otherwise(k))


#: What a rule's test may ask of a column, given the values.
TESTS: dict[str, Callable[[Column, list], Column]] = {
    "=": lambda c, v: c == v[0], "!=": lambda c, v: c != v[0], "<": lambda c, v: c < v[0], "<=": lambda c, v: c <= v[0],
    ">": lambda c, v: c > v[0], ">=": lambda c, v: c >= v[0], "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
    "null": lambda c, v: c.isNull(), "not null": lambda c, v: c.isNotNull()}


def rule_condition(tests: list[dict]) -> Column:
    """The conjunction of tests as a column: ``{column, op, values}``, ``{any: [tests, ...]}``
    for one list of tests out of several, ``{none: tests}`` for their negation. Rules are data, so nothing but
    columns and literals can be reached. A rule without tests fits all rows."""
    out = F.lit(True)
    for t in tests:
        if set(t) == {"any"}:
            own = F.lit(False)
            for other in t["any"]:
                own = own | rule_condition(other)
        elif set(t) == {"none"}:
            own = ~rule_condition(t["none"])
        else:
            values = t.get("values", [])
            if t.get("op") not in TESTS or not set(t) <= {"column", "op", "values"} or not isinstance(t.get("column"), str):
                raise ValueError(f"rule test {t!r}: a column and one of {', '.join(TESTS)} expected")
            if ("null" in t["op"]) != (not values) or ("in" not in t["op"].split() and len(values) > 1):
                raise ValueError(f"rule test {t!r}: wrong number of values")
            own = TESTS[t["op"]](F.col(t["column"]), values)
        out = out & own
    return out


def rules_policy(rules: list[dict]) -> Column:
    """Ordered rules ``{tests, action, priority, sample_rate}`` -> the
    first matching rule by priority as a nested CASE. Tests follow
    ``rule_condition``; ``sample_rate`` keeps a deterministic fraction via
    xxhash64(log_id)."""
    e = F.when(F.lit(False), F.lit(None))
    for r in sorted(rules, key=lambda r: -r.get("priority", 0)):
        rate = r.get("sample_rate")
        act = F.lit(r["action"])
        if rate is not None:
            keep = F.pmod(F.xxhash64("log_id"), F.lit(1000)) < int(rate * 1000)
            act = F.when(keep, F.lit("KEEP")).otherwise(F.lit("SUPPRESS"))
        e = e.when(rule_condition(r["tests"]), act)
    return e


def join_policies(df: DataFrame, policies: DataFrame, key: str = "key_tenant") -> DataFrame:
    """Per-tenant thresholds as columns, from a small, size-checked table."""
    from ..plans.guards import checked_broadcast
    b = checked_broadcast(policies, "policies")
    return df.join(b if b is not None else policies, key, "left")


def spike_topk(df: DataFrame, window: str = "10 minutes", k: int = 3, key: list[str] = ("key_tenant",)) -> DataFrame:
    """Top-k templates per tumbling window (by count, then template id)."""
    g = df.groupBy(*key, F.window(F.col("ts"), window).alias("win"), "template_id") \
        .agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key, "win").orderBy(F.col("n").desc(), "template_id")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
