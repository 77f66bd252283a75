"""Registered queries: name -> fn(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full. Output columns are plain scalars with explicit aliases; lists are
joined into strings so the SQL oracle can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import patterns as P
from .functions.redact import luhn_ok
from .operators.normalize import normalize
from .sources.tables import log_docs, log_events, log_pages, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__[2:]] = fn
    return fn


# ------------------------------------------------------------ job 2
def normalized_docs(spark, sf):
    return normalize(log_docs(spark, sf))


def normalized_events(spark, sf):
    return normalize(log_events(spark, sf))


@register
def q_schema_classify(spark, sf):
    d = log_docs(spark, sf).select(F.lit("docs").alias("source"), "payload")
    e = log_events(spark, sf).select(F.lit("events").alias("source"), "payload")
    p = read_table(spark, sf, "events").select(F.lit("props").alias("source"), F.col("props").alias("payload"))
    from .functions.text import detect_schema
    u = d.unionByName(e).unionByName(p)
    return (u.groupBy("source", detect_schema(F.col("payload")).alias("schema"))
             .agg(F.count(F.lit(1)).alias("records")))


@register
def q_redact_messages(spark, sf):
    n = normalized_docs(spark, sf)
    return n.select("log_id", "schema", "message", F.col("redaction.applied").alias("applied"),
                    F.array_join("redaction.rules", ",").alias("rules"),
                    F.col("redaction.count").cast("bigint").alias("redaction_count"))


@register
def q_redaction_by_rule(spark, sf):
    n = normalized_docs(spark, sf)
    return (n.select(F.explode("redaction.rules").alias("rule"))
             .groupBy("rule").agg(F.count(F.lit(1)).alias("records")))


@register
def q_luhn_cards(spark, sf):
    d = log_docs(spark, sf)
    cc = P.to_java(dict(P.REDACTION_RULES)["cc"])
    x = d.select("log_id", F.posexplode(F.regexp_extract_all("payload", F.lit(cc), 0)).alias("pos", "candidate"))
    return x.select("log_id", F.col("pos").cast("bigint").alias("pos"), "candidate",
                    luhn_ok(F.col("candidate")).alias("luhn_ok"))


# ------------------------------------------------------------ job 3
from .operators import templates as T  # noqa: E402
from .operators.templates import mine, template_memory, with_templates  # noqa: E402


def mined_docs(spark, sf):
    return with_templates(normalized_docs(spark, sf))


def mined_events(spark, sf, several: bool = False, columns: list[str] | None = None):
    """``several``: the caller reads the rows (of ``columns``) in more than one branch."""
    m = with_templates(normalized_events(spark, sf))
    m = m.select(*columns) if columns else m
    return T.materialize(m) if several else m


#: What catalogs, statistics and changes read of a record. Rows that are kept for several branches
#: are cut to what these read, as a kept row holds all its columns, read or not.
CATALOG_ROWS = ["log_id", "ts", "labels", "template_id", "template", "regex", "from_fallback"]
#: What the sampler reads of a record.
SAMPLER_ROWS = ["log_id", "ts", "tenant", "service", "env", "severity", "template_id"]


def sampler_rows(spark, sf):
    """What the sampler reads of a record, without payload and message."""
    return mined_events(spark, sf).select(*SAMPLER_ROWS)


@register
def q_mask_templates(spark, sf):
    m = with_templates(normalized_docs(spark, sf))
    return m.select("log_id", "template", "template_id", "group_signature", "token_seq", "from_fallback")


@register
def q_template_regex(spark, sf):
    m = with_templates(normalized_docs(spark, sf)).filter(~F.col("from_fallback"))
    return m.select("template_id", "template", "regex").distinct()


@register
def q_template_memory(spark, sf):
    mem = template_memory(mined_docs(spark, sf).select(*CATALOG_ROWS, "message"))
    return mem.select("template_id", "template", "first_seen", "last_seen", "n",
                      F.array_join("examples", "\n").alias("examples"))


@register
def q_provenance(spark, sf):
    m = mine(normalized_events(spark, sf))
    return m.select("log_id", "template_id", "provenance",
                    F.round(F.col("confidence").cast("double"), 6).alias("confidence"))


# ------------------------------------------------------------ job 4
from .operators.sampling import Policy, decide, enforce, minute_rollup, route, with_counters, with_key  # noqa: E402

TUNED = Policy(spike_factor=1.5, min_spike=2, warmup_n=4, budget_10m=3,
               steady_k={"DEBUG": 5, "INFO": 7, "WARN": 3})


@register
def q_minute_rollup(spark, sf):
    r = minute_rollup(with_key(sampler_rows(spark, sf)))
    return r.select("key_tenant", "template_id", "key_service", "key_env", "severity",
                    F.col("minute").cast("bigint").alias("minute"), "n")


@register
def q_window_counts(spark, sf):
    c = with_counters(with_key(sampler_rows(spark, sf)), ema=False)
    return c.select("log_id", "seq", "cur_min", "count_10m", "count_1h", "count_24h", "key_first_seen")


@register
def q_ema_per_record(spark, sf):
    c = with_counters(with_key(sampler_rows(spark, sf)))
    return c.select("log_id", "seq", F.round(F.col("ema") + 1e-9, 6).alias("ema"))


def _decisions(d):
    return d.select("log_id", "action", "keep_reason", "sample_rate", "note", "policy_version")


@register
def q_ladder_decisions(spark, sf):
    return _decisions(decide(sampler_rows(spark, sf)))


@register
def q_ladder_decisions_tuned(spark, sf):
    return _decisions(decide(sampler_rows(spark, sf), TUNED))


@register
def q_decisions_by_reason(spark, sf):
    d = decide(sampler_rows(spark, sf))
    return d.groupBy("action", "keep_reason").agg(F.count(F.lit(1)).alias("records"))


@register
def q_enforcement_split(spark, sf):
    d = enforce(decide(sampler_rows(spark, sf)))
    kept, sup = route(d)
    k = kept.groupBy("severity", "shadow").agg(F.count(F.lit(1)).alias("records")) \
        .withColumn("route", F.lit("kept"))
    s = sup.groupBy("severity").agg(F.count(F.lit(1)).alias("records")) \
        .withColumn("route", F.lit("suppressed")).withColumn("shadow", F.lit(False))
    return k.unionByName(s)


# ------------------------------------------------------------ job 6
from .operators import catalog as C  # noqa: E402

SPLIT = "2024-01-16 00:00:00"      # period boundary for change analysis
AS_OF = "2024-01-30 12:00:00"      # reference time for rolling windows


def _ntz(s):
    return F.lit(s).cast("timestamp_ntz")


def _catalog_out(cat):
    return cat.select("tenant", "template_id", "template_text", "regex",
                      F.col("labels")["service"].alias("label_service"),
                      F.col("labels")["env"].alias("label_env"),
                      F.col("labels")["severity"].alias("label_severity"),
                      "first_seen", "last_seen", "template_version")


def events_catalog(spark, sf):
    m = mined_events(spark, sf, several=True, columns=CATALOG_ROWS)
    prior = C.fold_catalog(C.to_candidates(m.filter(F.col("ts") < _ntz(SPLIT))))
    return C.fold_catalog(C.to_candidates(m.filter(F.col("ts") >= _ntz(SPLIT))), prior)


@register
def q_catalog_fold(spark, sf):
    return _catalog_out(events_catalog(spark, sf))


@register
def q_template_stats_long(spark, sf):
    # The longest window is 24 hours: older events are left out by the scan.
    day = log_events(spark, sf).filter((F.col("ts") > _ntz(AS_OF) - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= _ntz(AS_OF)))
    s = C.rolling_stats(with_templates(normalize(day)), _ntz(AS_OF))
    return s.select("tenant", "template_id", "window", "count", "updated_at")


@register
def q_catalog_by_dimension(spark, sf):
    return C.catalog_stats(events_catalog(spark, sf), _ntz(AS_OF)).select(
        "service", "severity", F.col("gid").cast("bigint").alias("gid"), "templates", "new_24h", "updated_24h")


@register
def q_template_detail(spark, sf):
    d = C.template_detail(mined_events(spark, sf, several=True))
    return d.select("template_id", "occurrences", "active_minutes", "peak_per_min",
                    F.round("mean_per_min", 6).alias("mean_per_min"), "spike_minutes",
                    F.array_join("examples", "\n").alias("examples"))


@register
def q_new_templates(spark, sf):
    return C.template_changes(mined_events(spark, sf, several=True, columns=CATALOG_ROWS), _ntz(SPLIT))


@register
def q_rate_delta(spark, sf):
    d = C.rate_delta(mined_events(spark, sf), _ntz(SPLIT))
    return d.select("tenant", "template_id", "n_before", "n_after", "delta", F.round("ratio", 6).alias("ratio"))


@register
def q_template_events(spark, sf):
    return C.template_events(mined_events(spark, sf, several=True), _ntz(SPLIT))


# ------------------------------------------------------------ jobs 7-8
from .operators import search as S  # noqa: E402

DOCS_END = "2024-01-01 12:00:00"   # reference "end" time for recency boosts over docs


def label_centroids(spark, sf):
    """Per label, the mean embedding (column-wise, partial-aggregated)."""
    e = read_table(spark, sf, "embeddings")
    x = e.select("label", F.posexplode("embedding").alias("pos", "v"))
    c = x.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return c.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))),
                                              lambda s: s["v"]).alias("qvec")) \
        .select(F.col("label").cast("string").alias("query_id"), "qvec")


@register
def q_knn_cosine(spark, sf):
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    hits = S.knn(label_centroids(spark, sf), e, 10, "id")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


def docs_catalog(spark, sf):
    from .operators.catalog import to_candidates
    return to_candidates(mined_docs(spark, sf))


def stored_catalog(spark, sf, mined=None):
    """The catalog of the documents, written once for the search and for what is read of its hits."""
    from .operators.catalog import to_candidates
    from .session import cut_lineage
    return cut_lineage(docs_catalog(spark, sf) if mined is None else to_candidates(mined), "catalog")


def docs_vectors(spark, sf):
    return S.template_vectors(docs_catalog(spark, sf))


@register
def q_embed_templates(spark, sf):
    v = docs_vectors(spark, sf)
    q = [F.aggregate(F.slice("embedding", 1 + 96 * i, 96), F.lit(0.0),
                     lambda a, x: a + x.cast("double")) for i in range(4)]
    return v.select("tenant", "template_id", F.size("embedding").cast("bigint").alias("dims"),
                    *[F.round(c, 5).alias(f"q{i + 1}_sum") for i, c in enumerate(q)])


def benchmark_queries(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))


def _hits_out(h):
    return h.select("query_id", "tenant", "template_id", F.round("score", 6).alias("score"),
                    F.col("rank").cast("bigint"))


@register
def q_knn_templates(spark, sf):
    return _hits_out(S.search(benchmark_queries(spark, sf), docs_vectors(spark, sf), k=10))


@register
def q_knn_filtered(spark, sf):
    q = benchmark_queries(spark, sf).withColumn("label_filter", F.create_map(
        F.lit("service"), F.lit("en"), F.lit("pod"), F.lit("ignored-key")))
    return _hits_out(S.search(q, docs_vectors(spark, sf), k=5))


@register
def q_recency_rerank(spark, sf):
    cat = stored_catalog(spark, sf)
    hits = S.search(benchmark_queries(spark, sf), S.template_vectors(cat), k=10)
    r = S.rerank_recent(S.attach_catalog(hits, cat), _ntz(DOCS_END))
    return r.select("query_id", "tenant", "template_id", F.col("rank").cast("bigint"),
                    F.col("rerank").cast("bigint"), F.round("boosted", 6).alias("boosted"))


@register
def q_matched_tokens(spark, sf):
    cat = stored_catalog(spark, sf)
    hits = S.search(benchmark_queries(spark, sf), S.template_vectors(cat), k=10)
    h = S.attach_catalog(hits, cat).join(benchmark_queries(spark, sf), "query_id")
    e = S.explain_hits(h)
    return e.select("query_id", "tenant", "template_id", F.array_join("matched_tokens", " ").alias("matched_tokens"))


# ------------------------------------------------------------ job 9
from .plans import logql as L  # noqa: E402


def docs_plans(spark, sf, normalized=None):
    cat = stored_catalog(spark, sf, None if normalized is None else with_templates(normalized))
    hits = S.search(benchmark_queries(spark, sf), S.template_vectors(cat), k=10)
    sel = S.attach_catalog(hits, cat)
    return L.plan(sel).withColumn("plan_id", F.concat_ws(":", "query_id", F.col("rank").cast("string")))


@register
def q_logql_strings(spark, sf):
    return docs_plans(spark, sf).select("query_id", F.col("rank").cast("bigint").alias("rank"), "logql")


def plan_lines(spark, sf):
    """What plans and the catalog they come from read of a line; kept, as it feeds both."""
    return T.materialize(normalized_docs(spark, sf).select("log_id", "ts", "labels", "message"))


@register
def q_plan_execute(spark, sf):
    logs = plan_lines(spark, sf)
    plans = docs_plans(spark, sf, logs)
    m = L.execute_plan(logs, plans)
    return m.groupBy(F.split("plan_id", ":")[0].alias("query_id"), "service") \
        .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("plan_id").alias("plans"))


@register
def q_rate_by_service(spark, sf):
    r = L.rate(log_events(spark, sf), ["service"])
    return r.select("window_start", "service", "n", F.round("rate", 6).alias("rate"))


@register
def q_logql_forms(spark, sf):
    cat = stored_catalog(spark, sf)
    sel = S.attach_catalog(S.search(benchmark_queries(spark, sf), S.template_vectors(cat), k=3), cat)
    lit = F.element_at(F.split("template_text", " "), 1)
    return sel.select("query_id", F.col("rank").cast("bigint").alias("rank"),
                      L.line_filter_query(F.col("labels"), lit).alias("line_filter"),
                      L.rate_query(F.col("labels"), lit).alias("rate_query"))


# ------------------------------------------------------------ jobs 1, 5, 10
from .functions.text import parse_label_string  # noqa: E402
from .operators import metrics as MX  # noqa: E402
from .sinks import lines as K  # noqa: E402
from .sources import payloads as SP  # noqa: E402


def _render_map(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@register
def q_label_parse(spark, sf):
    e = log_events(spark, sf)
    s = F.concat(F.lit('{service="'), F.col("service"), F.lit('", env='), F.col("env"), F.lit(", "),
                 F.lower("severity"), F.lit(', tenant="'), F.col("tenant"), F.lit('", env="'), F.col("env"),
                 F.lit('-x"}'))
    return e.select("log_id", _render_map(parse_label_string(s)).alias("labels"))


def _push_docs(spark, sf):
    e = log_events(spark, sf).withColumn("line", F.col("payload")).withColumn("sink_labels", F.col("labels"))
    e = e.withColumn("stream_key", K.stream_key(F.col("labels")))
    return K.push_payloads(K.push_chunks(e), fmt="entries")


@register
def q_push_roundtrip(spark, sf):
    raw, _ = SP.flatten_push(_push_docs(spark, sf).select(F.col("payload").alias("value")))
    return raw.select("ts", F.col("labels")["service"].alias("service"), F.col("labels")["env"].alias("env"),
                      F.col("labels")["severity"].alias("severity"), "payload")


SEV_NUM = {"DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17}


def _otlp_docs(spark, sf):
    from .operators.sampling import epoch_us
    e = log_events(spark, sf).withColumn("minute", F.floor(epoch_us() / 60_000_000))
    sevn = F.when(F.lit(False), None)
    for k, v in SEV_NUM.items():
        sevn = sevn.when(F.col("severity") == k, F.lit(v))
    rec = F.struct(
        (epoch_us() * 1000).cast("string").alias("timeUnixNano"), sevn.alias("severityNumber"),
        F.col("severity").alias("severityText"), F.struct(F.col("payload").alias("stringValue")).alias("body"),
        F.md5(F.concat(F.lit("u"), F.col("log_id").cast("string"))).alias("traceId"),
        F.substring(F.md5(F.col("log_id").cast("string")), 1, 16).alias("spanId"))
    g = e.groupBy("service", "env", "minute").agg(F.sort_array(F.collect_list(F.struct("ts", "log_id", rec.alias("r")))).alias("rs"))
    at = "struct<key:string,value:struct<stringValue:string,intValue:string>>"

    def attr(k, sv, iv):
        return F.struct(F.lit(k).alias("key"), F.struct(sv.alias("stringValue"), iv.alias("intValue")).alias("value")).cast(at)
    none = F.lit(None).cast("string")
    attrs = F.array(attr("service.name", F.col("service"), none), attr("env", F.col("env"), none),
                    attr("minute", none, F.col("minute").cast("string")))
    doc = F.struct(F.array(F.struct(F.struct(attrs.alias("attributes")).alias("resource"), F.array(F.struct(
        F.struct(F.lit("events").alias("name"), F.lit("1").alias("version")).alias("scope"),
        F.transform("rs", lambda x: x["r"]).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return g.select(F.to_json(doc).alias("value"))


@register
def q_otlp_flatten(spark, sf):
    r = SP.flatten_otlp(_otlp_docs(spark, sf))
    return r.select("ts", "ts_nanos", _render_map(F.col("labels")).alias("labels"), "payload")


def _json_docs(spark, sf):
    from .operators.sampling import epoch_us
    e = log_events(spark, sf).withColumn("minute", F.floor(epoch_us() / 60_000_000))
    rec = F.when(F.col("service") == "error", F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "labels", "payload",
        F.lit("error").alias("level")))).otherwise(F.to_json(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "labels", "payload")))
    g = e.groupBy("tenant", "minute").agg(F.sort_array(F.collect_list(F.struct("ts", "log_id", rec.alias("j")))).alias("rs"))
    return g.select(F.concat(F.lit('{"records":['), F.array_join(F.transform("rs", lambda x: x["j"]), ","),
                             F.lit("]}")).alias("value"))


@register
def q_json_batch_rejects(spark, sf):
    raw, rej = SP.read_json_batches(_json_docs(spark, sf))
    acc = raw.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted_records").alias("reason"), "n")
    return acc.unionByName(MX.rejects_by_reason(rej).select("reason", F.col("rejected").alias("n")))


def kept_entries(spark, sf):
    d = decided_events(spark, sf, "labels", "message", "schema", "redaction", "sanitized", "truncated")
    kept, _ = route(d)
    return K.to_sink_entries(kept)


@register
def q_enriched_lines(spark, sf):
    return kept_entries(spark, sf).select("log_id", "line")


@register
def q_stream_keys(spark, sf):
    return kept_entries(spark, sf).groupBy("stream_key").agg(F.count(F.lit(1)).alias("entries"))


@register
def q_push_chunks(spark, sf):
    c = K.push_payloads(K.push_chunks(kept_entries(spark, sf)))
    return c.select("stream_key", F.col("minute").cast("bigint").alias("minute"), "chunk", "entries", "bytes")


@register
def q_push_chunks_cut(spark, sf):
    """Small limits over a day's entries, so that both cuts occur."""
    c = K.push_payloads(K.push_chunks(kept_entries(spark, sf), max_entries=5, max_bytes=900, minutes=1440))
    return c.select("stream_key", F.col("minute").cast("bigint").alias("minute"), "chunk", "entries", "bytes")


@register
def q_load_shed(spark, sf):
    kept, dropped = K.shed(kept_entries(spark, sf), budget_entries=1)
    return dropped.groupBy(F.col("sink_labels")["severity"].alias("severity"), "reason") \
        .agg(F.count(F.lit(1)).alias("dropped"))


def decided_events(spark, sf, *more: str | Column):
    """Decided records with what the sampler reads of them, and ``more`` columns."""
    return enforce(decide(mined_events(spark, sf).select(*SAMPLER_ROWS, *more)))


@register
def q_sampling_metrics(spark, sf):
    m = MX.sampling_metrics(decided_events(spark, sf))
    return m.withColumn("sample_rate", F.round("sample_rate", 6))


@register
def q_suppressed_rollup(spark, sf):
    _, sup = route(decided_events(spark, sf, F.octet_length("message").alias("message_bytes")))
    return MX.suppressed_rollup(sup, "1 day", F.col("message_bytes"))


@register
def q_tenant_volume(spark, sf):
    return MX.tenant_volume(decided_events(spark, sf, "payload")).withColumn("kept_ratio", F.round("kept_ratio", 6))


@register
def q_records_by_schema(spark, sf):
    u = normalized_docs(spark, sf).select("protocol", "schema").unionByName(
        normalized_events(spark, sf).select("protocol", "schema"))
    return MX.records_by_schema(u)


@register
def q_active_streams(spark, sf):
    return MX.active_streams(kept_entries(spark, sf))


@register
def q_label_cardinality(spark, sf):
    return MX.label_cardinality(log_events(spark, sf))


@register
def q_message_histogram(spark, sf):
    n = normalized_docs(spark, sf)
    return MX.histogram(n, F.octet_length("message"), [64, 256, 1024, 4096, 16384], by=["service"]) \
        .select("service", F.col("bucket").cast("bigint"), "le", "count")


@register
def q_alerts(spark, sf):
    m = mined_events(spark, sf, several=True)
    rules = m.select("template_id").distinct().withColumn("min_count", F.lit(3)).withColumn("min_ratio", F.lit(2.0))
    a = MX.alerts(m, rules)
    return a.select("template_id", "window_start", "n", "prev_n", F.round("ratio", 6).alias("ratio"))


@register
def q_spike_topk(spark, sf):
    from .operators.sampling import spike_topk
    t = spike_topk(with_key(mined_events(spark, sf)), "1 day", 3)
    return t.select("key_tenant", F.col("win.start").alias("window_start"), "template_id", "n",
                    F.col("rank").cast("bigint"))


@register
def q_deploy_asof(spark, sf):
    m = mined_events(spark, sf, several=True)
    tmpl = m.groupBy("service", "template_id").agg(F.min("ts").alias("first_seen"))
    deploys = m.groupBy("service", F.to_date("ts").alias("d")).agg(F.min("ts").alias("deployed_at")) \
        .select("service", "deployed_at", F.concat_ws("@", "service", F.col("d").cast("string")).alias("deploy_id"))
    return MX.correlate_deploys(tmpl, deploys)


@register
def q_incident_keep(spark, sf):
    from .operators.sampling import keep_incident
    n = normalized_events(spark, sf).withColumn("correlation_id", F.concat(F.lit("u"),
                                                                           F.split("payload", " ")[1]))
    ev = read_table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("value") >= 99))
    inc = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"),
                    F.expr("timestampadd(HOUR, -1, ts)").alias("start"), F.expr("timestampadd(HOUR, 1, ts)").alias("end"))
    k = keep_incident(n, inc)
    return k.groupBy("service", "incident").agg(F.count(F.lit(1)).alias("records"))


# ------------------------------------------------------------ M1 Drain (rows-only check)
from .operators.drain import drain_parallel  # noqa: E402


@register
def q_drain_templates(spark, sf):
    d = drain_parallel(normalized_events(spark, sf).select("log_id", "ts", "tenant", "service", "message"), context=["service"])
    return d.select("log_id", "template_id", "template", F.round(F.col("confidence").cast("double"), 6).alias("confidence"),
                    "drain_cluster")


@register
def q_drain_docs(spark, sf):
    d = drain_parallel(normalized_docs(spark, sf).select("log_id", "ts", "tenant", "message"), count_as="lines")
    return d.groupBy("tenant", "template_id").agg(F.first("template").alias("template"),
                                                  F.sum("lines").alias("lines"))


@register
def q_drain_fits(spark, sf):
    """Every line fits its cluster's template, token by token, and every cluster has one new line."""
    d = drain_parallel(normalized_events(spark, sf), context=["service"])
    a, b = F.split(T.mask(F.trim("message")), "[\\t\\n\\f\\r \\x0B]+"), F.split("template", " ")
    fits = (F.size(a) == F.size(b)) & F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: (z["a"] == z["b"]) | (z["b"] == "<*>"))
    new = F.abs(F.col("confidence") - 0.5) < 1e-6
    return d.groupBy("tenant", "service").agg(
        F.count(F.lit(1)).alias("records"), F.count(F.when(~fits, 1)).alias("misfits"),
        (F.countDistinct("drain_cluster") - F.count(F.when(new, 1))).alias("clusters_without_first"))


# ------------------------------------------------------------ remaining operators


def events_templates(spark, sf):
    """Distinct (tenant, template) of the event logs (catalog rows)."""
    c = C.to_candidates(mined_events(spark, sf))
    return c.select("tenant", "template_id", F.col("template_text").alias("template"), "first_seen")


@register
def q_template_drift(spark, sf):
    d = T.template_drift(mined_events(spark, sf).filter(~F.col("from_fallback")))
    return d.select("leaf", "template_id", "first_seen", F.col("version").cast("bigint"))


@register
def q_template_similarity(spark, sf):
    t = events_templates(spark, sf)
    pairs = T.hamming_neighbors(t, ["tenant"])
    a = t.select("tenant", F.col("template_id").alias("id_a"), F.col("template").alias("template_a"))
    b = t.select("tenant", F.col("template_id").alias("id_b"), F.col("template").alias("template_b"))
    p = pairs.join(a, ["tenant", "id_a"]).join(b, ["tenant", "id_b"])
    s = T.template_similarity(p)
    return s.select("tenant", "id_a", "id_b", F.round("edit_norm", 6).alias("edit_norm"),
                    F.round("jaccard", 6).alias("jaccard"), F.col("hamming").cast("bigint"))


@register
def q_merge_templates(spark, sf):
    m = T.merge_templates(events_templates(spark, sf), ["tenant"])
    return m.select("tenant", "template_id", "canonical_id")


@register
def q_split_candidates(spark, sf):
    return T.split_candidates(mined_events(spark, sf), limit=50)


@register
def q_grouping_buckets(spark, sf):
    g = T.grouping_buckets(normalized_events(spark, sf))
    return g.select("tenant", "masked", "bucket", "size", "first_seen", "last_seen",
                    F.array_join("exemplars", "\n").alias("exemplars"))


@register
def q_refine_budget(spark, sf):
    r = T.refine_budget(normalized_docs(spark, sf), qpm=60)
    return r.groupBy("tenant", "refine_allowed").agg(F.count(F.lit(1)).alias("records"))


CUSTOM_RULES = [
    {"rule_id": "purchase", "priority": 10, "pattern": r"^user \S+ purchase ", "template": "user <*> purchase <*>"},
    {"rule_id": "error", "priority": 5, "pattern": r" error value=", "template": "user <*> error value=<*>"},
]


@register
def q_custom_templates(spark, sf):
    c = T.apply_custom_templates(mined_events(spark, sf), CUSTOM_RULES)
    return c.groupBy("custom_rule", "template_id", "template").agg(F.count(F.lit(1)).alias("records"))


@register
def q_p95_spikes(spark, sf):
    from .operators.sampling import p95_spikes
    return p95_spikes(sampler_rows(spark, sf), window_minutes=60, factor=1.0).filter("spike")


@register
def q_budget_k(spark, sf):
    from .operators.sampling import budget_k
    b = budget_k(with_key(log_events(spark, sf)), max_qps=0.5)
    return b.groupBy("key_tenant", "severity", "k_eff").agg(F.count(F.lit(1)).alias("records"))


@register
def q_template_browse(spark, sf):
    page, total, more = L.list_templates(events_catalog(spark, sf), filters={"service": "click"}, limit=20, offset=5)
    return page.select("tenant", "template_id", "last_seen", F.lit(total).cast("bigint").alias("total"),
                       F.lit(more).alias("has_more"))


@register
def q_retain(spark, sf):
    pol = spark.createDataFrame([("t0", 7), ("t1", 14)], "tenant string, retention_days int")
    r = K.retain(log_events(spark, sf), pol, "2024-01-31 00:00:00")
    return r.groupBy("tenant").agg(F.count(F.lit(1)).alias("records"), F.min("ts").alias("oldest"))


@register
def q_publish_ack(spark, sf):
    cand = C.candidate_defaults(C.to_candidates(mined_docs(spark, sf)), _ntz(AS_OF))
    ok, bad = C.validate_candidates(cand)
    return C.publish_ack(ok, bad)


@register
def q_vector_reembed(spark, sf):
    m = mined_events(spark, sf, several=True)
    before = C.fold_catalog(C.to_candidates(m.filter(F.col("ts") < _ntz(SPLIT))))
    after = events_catalog(spark, sf)
    todo = S.needs_embedding(after, S.template_vectors(before))
    return todo.select("tenant", "template_id", "template_version",
                       S.point_id(F.col("template_id")).cast("string").alias("point_id"))


@register
def q_promote_fields(spark, sf):
    from .operators.normalize import promote_fields
    f = promote_fields(normalized_events(spark, sf))
    return f.select(F.explode("fields").alias("k", "v")).groupBy("k").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("v").alias("values"))


@register
def q_oversize_rejects(spark, sf):
    from .operators.normalize import reject_oversize
    p = read_table(spark, sf, "pages").select(F.col("page_id").alias("log_id"), F.col("html").alias("payload"))
    ok, bad = reject_oversize(p, max_log_size=16384)
    return MX.rejects_by_reason(bad).unionByName(
        ok.agg(F.count(F.lit(1)).alias("rejected")).select(F.lit("accepted").alias("reason"), "rejected"))


@register
def q_redact_pages(spark, sf):
    n = normalize(log_pages(spark, sf))
    return n.select("log_id", "schema", "message", F.array_join("redaction.rules", ",").alias("rules"),
                    F.col("redaction.count").cast("bigint").alias("redaction_count"))


# ------------------------------------------------------------ ties, tenants, losses
@register
def q_knn_ties(spark, sf):
    """Every vector under several ids: equal scores are ordered by id."""
    e = read_table(spark, sf, "embeddings")
    e = e.select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("copy"), "vec_id", "embedding")
    e = e.select(F.concat_ws("-", "copy", "vec_id").alias("id"), "embedding")
    hits = S.knn(label_centroids(spark, sf), e, 10, "id")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


@register
def q_knn_tenant(spark, sf):
    """Each query in one tenant, with a label that is blank and so not asked for."""
    q = benchmark_queries(spark, sf)
    q = q.withColumn("tenant", F.concat(F.lit("src"), F.pmod(F.col("query_id").cast("int"), F.lit(20)).cast("string")))
    q = q.withColumn("label_filter", F.create_map(F.lit("service"), F.lit("en"), F.lit("env"), F.lit(" ")))
    return _hits_out(S.search(q, docs_vectors(spark, sf), k=5))


@register
def q_knn_no_match(spark, sf):
    q = benchmark_queries(spark, sf).withColumn("tenant", F.lit("nobody"))
    return _hits_out(S.search(q, docs_vectors(spark, sf), k=5))


@register
def q_null_keys_decided(spark, sf):
    """Records without a time or a severity are decided, too."""
    r = sampler_rows(spark, sf)
    r = r.withColumn("ts", F.when(F.pmod("log_id", F.lit(7)) != 0, F.col("ts")))
    r = r.withColumn("severity", F.when(F.pmod("log_id", F.lit(5)) != 0, F.col("severity")))
    d = decide(r)
    return d.groupBy(F.col("ts").isNull().alias("untimed"), F.col("severity").isNull().alias("no_severity"),
                     "policy_version").agg(F.count(F.lit(1)).alias("records"), F.count("seq").alias("counted"))


@register
def q_plan_wildcard(spark, sf):
    """Plans that name no service match lines of every service."""
    logs = plan_lines(spark, sf)
    plans = docs_plans(spark, sf, logs).withColumn("labels", F.map_filter("labels", lambda k, v: k != "service"))
    m = L.execute_plan(logs, plans)
    return m.groupBy(F.split("plan_id", ":")[0].alias("query_id"), "service") \
        .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("plan_id").alias("plans"))


@register
def q_schema_edges(spark, sf):
    """Schema detection of one text per kind and event: the event's JSON with white space, a repeated key, or more behind it."""
    from .functions.text import detect_schema
    e, a = read_table(spark, sf, "events").select(F.col("event_id").cast("string").alias("i")), F.lit('{"a":')
    kinds = {"tab": F.concat(F.lit("\t "), a, "i", F.lit("}\n")), "twice": F.concat(a, "i", F.lit(',"a":2}')),
             "behind": F.concat(a, "i", F.lit("} x")), "two": F.concat(a, "i", F.lit('},{"b":1}')),
             "quotes": F.concat(F.lit("{'a':"), "i", F.lit("}")), "pair": F.concat(F.lit("a="), "i"), "plain": F.concat(F.lit("line "), "i")}
    x = e.select(F.explode(F.array(*[F.struct(F.lit(k).alias("case_id"), v.alias("payload")) for k, v in kinds.items()])).alias("x")).select("x.*")
    return x.groupBy("case_id", detect_schema(F.col("payload")).alias("schema")).agg(F.count(F.lit(1)).alias("records"))


def _one_otlp(body, attrs, ts):
    doc = F.struct(F.array(F.struct(F.struct(attrs.alias("attributes")).alias("resource"), F.array(F.struct(
        F.array(F.struct(ts.alias("timeUnixNano"), F.struct(body.alias("stringValue")).alias("body"))).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    return F.to_json(doc)


def _attr(k, v):
    return F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))


@register
def q_source_rejects(spark, sf):
    """Every fourth document does not parse, every fourth holds a record that is not valid UTF-8."""
    e = read_table(spark, sf, "events")
    good = _one_otlp(F.lit("x"), F.array(_attr("service", F.col("event_type"))), F.lit("1"))
    at = F.instr(good, '"stringValue":"x"')
    broken = F.concat(F.substring(good, F.lit(1), at + 14).cast("binary"), F.unhex(F.lit("FF")),
                      F.substring(good, at + 15, F.length(good)).cast("binary")).cast("string")
    value = F.when(F.pmod("event_id", F.lit(4)) == 0, F.lit("{not json")).when(F.pmod("event_id", F.lit(4)) == 1, broken).otherwise(good)
    return SP.otlp_rejects(e.select(value.alias("value"))).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


@register
def q_otlp_edge(spark, sf):
    """Push times with an offset; OTLP attributes given twice, of which the last counts."""
    e = read_table(spark, sf, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    push = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit('{service="'), F.col("event_type"), F.lit('"}')).alias("labels"), F.array(F.struct(
        stamp.alias("ts"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("line"))).alias("entries"))).alias("streams")))
    raw, _ = SP.flatten_push(e.select(push.alias("value")))
    twice = F.array(_attr("service", F.lit("first")), _attr("service", F.col("event_type")))
    otlp = SP.flatten_otlp(e.select(_one_otlp(F.lit("x"), twice, F.lit("1")).alias("value"))).groupBy(F.col("labels")["service"].alias("service")).agg(F.count(F.lit(1)).alias("n"))
    known = otlp.filter("service != 'first'").select("service")
    return raw.select("ts", F.col("labels")["service"].alias("service"), "payload").join(known, "service", "left_semi") \
        .groupBy("ts", "service", "payload").agg(F.count(F.lit(1)).alias("records")).select("ts", "service", "payload", "records")


@register
def q_rules_policy(spark, sf):
    from .operators.sampling import rules_policy
    def test(column, op, *values):
        return {"column": column, "op": op, "values": list(values)}
    rules = [{"tests": [test("severity", "in", "ERROR", "FATAL")], "action": "KEEP", "priority": 9},
             {"tests": [test("service", "=", "click"), test("env", "!=", "prod")], "action": "SUPPRESS", "priority": 5},
             {"tests": [test("tenant", ">=", "t1"), test("service", "in", "view", "signup")], "action": "KEEP", "priority": 1}]
    a = F.coalesce(rules_policy(rules), F.lit("none"))
    return log_events(spark, sf).groupBy(a.alias("action")).agg(F.count(F.lit(1)).alias("records"))


@register
def q_vector_upsert(spark, sf):
    """Vectors replaced by (tenant, template) where a newer one arrives."""
    v = S.template_vectors(C.to_candidates(mined_events(spark, sf))).withColumn("origin", F.lit("old"))
    new = v.filter(F.col("template_id").startswith("0")).withColumn("last_seen", F.expr("last_seen + INTERVAL 1 DAY")).withColumn("origin", F.lit("new"))
    return S.upsert_vectors(v, new).select("tenant", "template_id", "last_seen", "origin")


@register
def q_redact_page_bodies(spark, sf):
    """The whole source of every page, redacted."""
    bodies = read_table(spark, sf, "pages").select(F.col("page_id").alias("log_id"), F.col("html").alias("payload"))
    n = normalize(bodies, max_message_bytes=1 << 30)
    return n.select("log_id", "message", F.array_join("redaction.rules", ",").alias("rules"),
                    F.col("redaction.count").cast("bigint").alias("redaction_count"))


@register
def q_truncate_docs(spark, sf):
    """Byte limits never cut a code point, and keep a replacement mark the text itself holds."""
    from .functions.text import truncate_bytes
    d = log_docs(spark, sf).select("log_id", F.concat(F.col("payload"), F.lit("\uFFFD")).alias("p"))
    return d.select("log_id", truncate_bytes(F.col("p"), 40).alias("cut"), truncate_bytes(F.substring("p", -9, 9), 11).alias("tail"))


@register
def q_label_defaults(spark, sf):
    """Severity and tenant from labels: which label, any case, blanks, unknown names."""
    from .functions.text import severity_label, tenant_of
    k = F.pmod("log_id", F.lit(4))
    key = F.when(k == 0, "severity").when(k == 1, "severity_text").when(k == 2, "level").otherwise("other")
    value = F.when(F.pmod("log_id", F.lit(3)) == 0, F.lit("Loud")).otherwise(F.concat(F.lit(" "), F.initcap(F.lower("severity"))))
    tenant_key = F.when(F.pmod("log_id", F.lit(2)) == 0, "tenant").otherwise("tenant_id")
    labels = F.create_map(key, value, tenant_key, F.when(F.pmod("log_id", F.lit(5)) == 0, F.lit("  ")).otherwise(F.col("tenant")))
    e = log_events(spark, sf)
    return e.groupBy(severity_label(labels).alias("severity"), tenant_of(labels).alias("tenant")).agg(F.count(F.lit(1)).alias("records"))


@register
def q_stack_traces(spark, sf):
    from .operators.normalize import collapse_stack
    e = log_events(spark, sf)
    frames = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod("log_id", F.lit(3)).cast("int") + 1), lambda i: F.concat(F.lit("\n\tat call"), i.cast("string"))), "")
    p = F.when(F.pmod("log_id", F.lit(2)) == 0, F.concat(F.col("payload"), frames, F.lit("\nCaused by: x"))).otherwise(F.col("payload"))
    c = collapse_stack(e.withColumn("payload", p))
    return c.select("log_id", "stack_head", F.col("stack_frames").cast("bigint").alias("stack_frames"), "stack_hash")


@register
def q_aligned_results(spark, sf):
    """Results joined to their inputs: the last of repeated results, a default where there is none."""
    e = log_events(spark, sf).select("log_id", "service")
    res = e.filter(F.pmod("log_id", F.lit(3)) != 0).select("log_id", F.explode(F.sequence(F.lit(1), F.pmod("log_id", F.lit(3)).cast("int") + 1)).alias("seq"))
    res = res.withColumn("template_id", F.format_string("t%d", "seq"))
    return T.align(e, res, fallback={"template_id": "missing"}).groupBy("service", "template_id").agg(F.count(F.lit(1)).alias("records"))


@register
def q_catalog_filtered(spark, sf):
    c = S.filter_catalog(events_catalog(spark, sf), {"service": ["click", "error"], "env": "prod"}, start="2024-01-05 00:00:00", end="2024-01-20 00:00:00")
    return c.select("tenant", "template_id", "first_seen", "last_seen")


@register
def q_sink_files(spark, sf):
    """Kept lines in compressed files by tenant and date, read back."""
    from .session import scratch_path
    path = scratch_path(spark, "sink")
    k = K.kept_table(log_events(spark, sf).select("log_id", "ts", "tenant", F.col("payload").alias("line")))
    K.write_logs(k, path, "json", ["tenant", "date"], "gzip")
    back = spark.read.schema("log_id long, ts timestamp_ntz, line string, tenant string, date date").json(path)
    return back.groupBy("tenant", "date").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("line")).alias("chars"))


BUDGETED = Policy(novelty=False, log2=False, warmup_n=3, min_spike=1000, budget_10m=2, steady_k={"DEBUG": 2})
TENANT_POLICIES = {"t0": Policy(warmup_n=1), "t1": Policy(warmup_n=3)}


@register
def q_ladder_budget(spark, sf):
    """All events under one key, so that ten minutes hold more than the budget."""
    e = log_events(spark, sf).select("log_id", "ts", *[F.lit(v).alias(k) for k, v in (
        ("tenant", "t"), ("service", "s"), ("env", "e"), ("severity", "DEBUG"), ("payload", "tick"))])
    return _decisions(decide(with_templates(normalize(e)), BUDGETED))


@register
def q_ladder_novelty_window(spark, sf):
    return _decisions(decide(sampler_rows(spark, sf), Policy(novelty_hours=24.0)))


@register
def q_ladder_by_tenant(spark, sf):
    """Two tenants with thresholds of their own, the third with the defaults."""
    rows = [(t, p.warmup_n) for t, p in TENANT_POLICIES.items()]
    return _decisions(decide(sampler_rows(spark, sf), policies=spark.createDataFrame(rows, "key_tenant string, warmup_n bigint")))


@register
def q_ema_per_minute(spark, sf):
    from .operators.sampling import KEY, ema_per_minute
    r = ema_per_minute(sampler_rows(spark, sf))
    return r.select(*KEY, F.col("minute").cast("bigint").alias("minute"), "n", F.round("baseline", 6).alias("baseline"))


@register
def q_template_spikes(spark, sf):
    """Events of the last 20 days against the 10 before them: rates, not counts."""
    return C.template_events(mined_events(spark, sf, several=True), _ntz("2024-01-11 00:00:00"), 1.5, (10, 20))


@register
def q_catalog_upsert_text(spark, sf):
    """An older candidate with another version replaces the text, but not the times."""
    stored = C.to_candidates(mined_events(spark, sf, several=True))
    late = stored.withColumn("last_seen", F.expr("last_seen - INTERVAL 40 DAYS")).withColumn("first_seen", F.col("last_seen"))
    late = late.withColumn("template_version", F.when(F.col("template_id") < "8", F.lit("other")).otherwise(F.col("template_version")))
    late = late.withColumn("template_text", F.when(F.col("template_id") < "8", F.lit("new text")).otherwise(F.lit("ignored")))
    return C.fold_catalog(late, stored, faithful=True).select("tenant", "template_id", "template_text", "first_seen", "last_seen")


# ------------------------------------------------------------ committed tables, indexes, time ranges
@register
def q_catalog_commits(spark, sf):
    """Ten days at a time into a committed catalog table, the second batch sent twice."""
    from .session import scratch_path
    m, path = mined_events(spark, sf, several=True), scratch_path(spark, "catalog")
    edges = [None, "2024-01-11 00:00:00", "2024-01-21 00:00:00", None]
    for n in (0, 1, 1, 2):
        lo, hi = edges[n], edges[n + 1]
        part = m.filter((F.col("ts") >= _ntz(lo)) if lo else F.lit(True)).filter((F.col("ts") < _ntz(hi)) if hi else F.lit(True))
        cat = C.upsert_catalog(path, C.to_candidates(part), "events", n)
    return _catalog_out(cat)


@register
def q_stats_commits(spark, sf):
    """Rolling counts as of two times in one committed table: the last write per window wins."""
    from .session import scratch_path
    m, path = mined_events(spark, sf, several=True), scratch_path(spark, "stats")
    for n, as_of in enumerate(("2024-01-30 00:00:00", AS_OF)):
        stats = C.upsert_stats(path, C.rolling_stats(m, _ntz(as_of)), "events", n)
    return stats.select("tenant", "template_id", "window", "count", "updated_at")


@register
def q_knn_ann(spark, sf):
    """Search through inverted lists, all of them probed."""
    from .operators.vector_index import VectorIndex
    from .session import scratch_path
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    index = VectorIndex.build(e, scratch_path(spark, "vectors"))
    hits = index.search(label_centroids(spark, sf), 10, len(index.centroids))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint"))


RANGE = ("2024-01-01 00:30:00", "2024-01-01 06:00:00")


@register
def q_knn_time_range(spark, sf):
    """Templates seen within a time range, with one of several services; every third query is blank."""
    q = benchmark_queries(spark, sf)
    q = q.withColumn("query", F.when(F.pmod(F.col("query_id").cast("int"), F.lit(3)) == 0, F.lit(" ")).otherwise(F.col("query")))
    q = q.withColumn("label_filter", F.create_map(F.lit("service"), F.array(F.lit("en"), F.lit("fr"))))
    q = q.withColumn("start", _ntz(RANGE[0])).withColumn("end", _ntz(RANGE[1]))
    return _hits_out(S.search(q, docs_vectors(spark, sf), k=5))


@register
def q_hits_with_counts(spark, sf):
    """Hits with what the stats table counted in the last 24 hours, 0 where it has nothing."""
    m = T.materialize(mined_docs(spark, sf).select(*CATALOG_ROWS))  # feeds the catalog and the statistics
    cat = stored_catalog(spark, sf, m)
    hits = S.search(benchmark_queries(spark, sf), S.template_vectors(cat), k=10)
    h = S.attach_catalog(hits, cat, C.rolling_stats(m, _ntz("2024-01-01 20:00:00")))
    return h.select("query_id", "tenant", "template_id", F.col("rank").cast("bigint").alias("rank"), F.col("count_24h").cast("bigint").alias("count_24h"))


def _executed(m):
    return m.groupBy(F.split("plan_id", ":")[0].alias("query_id"), "service") \
        .agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("plan_id").alias("plans"))


@register
def q_plan_execute_range(spark, sf):
    """Plans over the lines of a time range."""
    logs = plan_lines(spark, sf)
    return _executed(L.execute_plan(logs, docs_plans(spark, sf, logs), *RANGE))


@register
def q_plan_indexed(spark, sf):
    """The same from stored lines and an index of their tokens."""
    from .plans.token_index import TokenIndex
    from .session import scratch_path
    logs = plan_lines(spark, sf)
    index = TokenIndex.build(logs, scratch_path(spark, "token_index"))
    return _executed(index.execute(docs_plans(spark, sf, logs), *RANGE))


@register
def q_null_rows_everywhere(spark, sf):
    """Events without a payload, a time or a tenant through every operator that splits, joins or drops rows."""
    from .operators.normalize import drop_blank, reject_oversize, utf8_policy
    from .operators.sampling import budget_k
    e = log_events(spark, sf)
    null = lambda c, n: F.when(F.pmod("log_id", F.lit(n)) != 0, F.col(c))
    e = T.materialize(e.withColumns({"payload": null("payload", 3), "ts": null("ts", 7), "tenant": null("tenant", 5)}))

    def out(name, rows, marked):
        return rows.agg(F.lit(name).alias("operator"), F.count(F.lit(1)).alias("records"), F.count(F.when(marked, 1)).alias("marked"))

    def two(name, parts):
        ok, bad = parts
        return out(name, ok.select(F.lit(False).alias("bad")).unionByName(bad.select(F.lit(True).alias("bad"))), F.col("bad"))

    rows = e.withColumn("message", F.col("payload"))
    policy = spark.createDataFrame([("t0", 7)], "tenant string, retention_days int")
    mined = T.mine_distinct(rows, lambda d: d.withColumn("found", F.lit(True)))
    buckets = T.grouping_buckets(rows)
    sums = buckets.agg(F.lit("buckets").alias("operator"), F.sum("size").alias("records"), F.count(F.when(F.col("exemplars").isNull(), 1)).alias("marked"))
    parts = [two("utf8", utf8_policy(e)), two("size", reject_oversize(e, 50)), out("templates", with_templates(rows), F.col("from_fallback")),
             out("not_blank", drop_blank(rows), F.col("tenant").isNull()), out("retained", K.retain(e, policy, "2024-01-31 00:00:00"), F.col("ts").isNull()),
             out("mined_once", mined, F.col("found")), sums, out("budget", budget_k(with_key(e), 0.5), F.col("k_eff").isNotNull())]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@register
def q_publish_ack_rejects(spark, sf):
    """Candidates of which some have no id, text or regex: counted, with the least of their errors."""
    c = C.candidate_defaults(C.to_candidates(mined_events(spark, sf)), _ntz(AS_OF))
    first = F.substring("template_id", 1, 1)
    c = c.withColumn("template_text", F.when(first.isin("0", "1"), F.lit("")).otherwise(F.col("template_text")))
    c = c.withColumn("regex", F.when(first.isin("1", "2"), F.lit(None)).otherwise(F.col("regex")))
    c = c.withColumn("template_id", F.when(first == "3", F.lit("")).otherwise(F.col("template_id")))
    ok, bad = C.validate_candidates(c)
    by = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    ack = C.publish_ack(ok, bad)
    return ack.select(F.lit("ack").alias("kind"), "accepted", "rejected", "note").unionByName(
        by.select(F.lit("reason").alias("kind"), F.lit(0).cast("bigint").alias("accepted"), F.col("n").alias("rejected"), F.col("reason").alias("note")))


@register
def q_signature_cache(spark, sf):
    """Mining calls and cached records per tenant, with a cache that forgets after two days."""
    rows = log_events(spark, sf).select("log_id", "ts", "tenant", F.concat_ws(" ", F.lit("user"), "service", "env").alias("message"))
    c = T.mine_cached(rows, lambda d: d.withColumn("template", T.mask(F.col("message"))), "2 days")
    return c.groupBy("tenant", "template").agg(F.count(F.when(~F.col("cached"), 1)).alias("calls"), F.count(F.when(F.col("cached"), 1)).alias("cached"))


@register
def q_ladder_qps(spark, sf):
    """Tenants over half a record a second: their DEBUG and INFO records are kept at a raised rate."""
    return _decisions(decide(sampler_rows(spark, sf), TUNED, max_qps=0.5))
