"""Oracle SQL per registered query (DuckDB dialect), keyed like ``registry.QUERIES``."""

from __future__ import annotations

from .functions import patterns as P
from .functions.patterns import sql_str as q
from .oracle_sql import (KEYS, LOG_DOCS, LOG_EVENTS, UNI_WS, luhn, normalized_ctes, with_)

ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


@oracle("schema_classify")
def _():
    logfmt = q(P.LOGFMT_PAIR)
    bare = f"regexp_replace(payload, '^{UNI_WS}+|{UNI_WS}+$', '', 'g')"
    cls = f"""CASE WHEN starts_with({bare}, '{{') AND json_valid({bare}) THEN 'JSON'
            WHEN NOT starts_with({bare}, '{{') AND regexp_matches(payload, {logfmt}) THEN 'LOGFMT'
            ELSE 'TEXT' END"""
    return with_(LOG_DOCS, LOG_EVENTS, """u AS (
  SELECT 'docs' AS source, payload FROM log_docs
  UNION ALL SELECT 'events', payload FROM log_events
  UNION ALL SELECT 'props', props FROM events)""") + \
        f"SELECT source, {cls} AS schema, count(*) AS records FROM u GROUP BY ALL"


@oracle("redact_messages")
def _():
    return with_(*normalized_ctes("log_docs")) + \
        "SELECT log_id, schema, message, applied, rules, redaction_count FROM norm"


@oracle("redaction_by_rule")
def _():
    return with_(*normalized_ctes("log_docs")) + \
        "SELECT rule, count(*) AS records FROM (SELECT unnest(rd_rules) AS rule FROM norm) GROUP BY rule"


@oracle("luhn_cards")
def _():
    cc = q(dict(P.REDACTION_RULES)["cc"])
    return with_(LOG_DOCS, f"""c AS (SELECT log_id, regexp_extract_all(payload, {cc}) AS cands FROM log_docs),
x AS (SELECT log_id, CAST(unnest(generate_series(0, len(cands) - 1)) AS BIGINT) AS pos,
             unnest(cands) AS candidate FROM c WHERE len(cands) > 0)""") + \
        f"SELECT log_id, pos, candidate, {luhn('candidate')} AS luhn_ok FROM x"


# ------------------------------------------------------------ job 3
from .oracle_sql import counter_ctes, decided_ctes, ema_ctes, mined_ctes  # noqa: E402
from .operators.sampling import Policy, ema_alpha  # noqa: E402


@oracle("mask_templates")
def _():
    return with_(*mined_ctes("log_docs")) + \
        "SELECT log_id, template, template_id, group_signature, token_seq, from_fallback FROM tm2"


@oracle("template_regex")
def _():
    return with_(*mined_ctes("log_docs")) + \
        "SELECT DISTINCT template_id, template, regex FROM tm2 WHERE NOT from_fallback"


@oracle("template_memory")
def _():
    return with_(*mined_ctes("log_docs"), """ex AS (
  SELECT template_id, string_agg(message, chr(10) ORDER BY ts DESC, log_id DESC) AS examples
  FROM (SELECT template_id, message, ts, log_id,
               row_number() OVER (PARTITION BY template_id ORDER BY ts DESC, log_id DESC) AS rn
        FROM tm2 WHERE NOT from_fallback) WHERE rn <= 3 GROUP BY template_id)""") + """
SELECT t.template_id, any_value(t.template) AS template, min(ts) AS first_seen, max(ts) AS last_seen,
       count(*) AS n, any_value(ex.examples) AS examples
FROM tm2 t JOIN ex USING (template_id) WHERE NOT from_fallback GROUP BY t.template_id"""


@oracle("provenance")
def _():
    return with_(*mined_ctes("log_events")) + """SELECT log_id, template_id, provenance,
  round(CAST(CAST(CASE provenance WHEN 'FALLBACK' THEN 0.0 WHEN 'HEURISTIC' THEN 0.5 ELSE 0.9 END AS FLOAT) AS DOUBLE), 6)
  AS confidence FROM mined"""


# ------------------------------------------------------------ job 4
TUNED = Policy(spike_factor=1.5, min_spike=2, warmup_n=4, budget_10m=3,
               steady_k={"DEBUG": 5, "INFO": 7, "WARN": 3})


@oracle("minute_rollup")
def _():
    return with_(*counter_ctes("log_events")) + """SELECT key_tenant, template_id, key_service, key_env,
  severity, cur_minute AS minute, count(*) AS n FROM sk GROUP BY ALL"""


@oracle("window_counts")
def _():
    return with_(*counter_ctes("log_events")) + \
        "SELECT log_id, seq, cur_min, count_10m, count_1h, count_24h, key_first_seen FROM cnt"


@oracle("ema_per_record")
def _():
    return "WITH RECURSIVE " + with_(*ema_ctes("log_events", ema_alpha(10.0)))[5:] + \
        "SELECT log_id, seq, round(ema + 1e-9, 6) AS ema FROM em"


def _decided(policy):
    return "WITH RECURSIVE " + with_(*decided_ctes("log_events", policy))[5:]


@oracle("ladder_decisions")
def _():
    return _decided(Policy()) + "SELECT log_id, action, keep_reason, sample_rate, note, policy_version FROM decided"


@oracle("ladder_decisions_tuned")
def _():
    return _decided(TUNED) + "SELECT log_id, action, keep_reason, sample_rate, note, policy_version FROM decided"


@oracle("decisions_by_reason")
def _():
    return _decided(Policy()) + "SELECT action, keep_reason, count(*) AS records FROM decided GROUP BY ALL"


@oracle("enforcement_split")
def _():
    return _decided(Policy()) + """, en AS (SELECT *, severity IN ('FATAL', 'DEBUG') AS enforced FROM decided)
SELECT severity, NOT enforced AS shadow, count(*) AS records, 'kept' AS route
FROM en WHERE NOT (enforced AND action = 'SUPPRESS') GROUP BY ALL
UNION ALL
SELECT severity, FALSE, count(*), 'suppressed' FROM en WHERE enforced AND action = 'SUPPRESS' GROUP BY ALL"""


# ------------------------------------------------------------ job 6
SPLIT = "TIMESTAMP '2024-01-16 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-30 12:00:00'"


def _cand(where: str, name: str) -> str:
    return f"""{name} AS (SELECT tenant, template_id,
  arg_max(template, (ts, log_id)) AS template_text, arg_max(regex, (ts, log_id)) AS regex,
  arg_max(service, (ts, log_id)) AS label_service, arg_max(env, (ts, log_id)) AS label_env,
  arg_max(lower(severity), (ts, log_id)) AS label_severity,
  min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n
  FROM mined WHERE NOT from_fallback AND {where} GROUP BY tenant, template_id)"""


def _catalog_ctes() -> list[str]:
    return mined_ctes("log_events") + [
        _cand(f"ts < {SPLIT}", "c_before"), _cand(f"ts >= {SPLIT}", "c_after"),
        """u AS (SELECT *, 0 AS src FROM c_before UNION ALL SELECT *, 1 AS src FROM c_after)""",
        """cat AS (SELECT tenant, template_id,
  arg_max(template_text, (last_seen, src)) AS template_text, arg_max(regex, (last_seen, src)) AS regex,
  arg_max(label_service, (last_seen, src)) AS label_service, arg_max(label_env, (last_seen, src)) AS label_env,
  arg_max(label_severity, (last_seen, src)) AS label_severity,
  min(first_seen) AS first_seen, max(last_seen) AS last_seen
  FROM u GROUP BY tenant, template_id)"""]


@oracle("catalog_fold")
def _():
    return with_(*_catalog_ctes()) + """SELECT tenant, template_id, template_text, regex, label_service,
  label_env, label_severity, first_seen, last_seen,
  substr(sha1(template_text || chr(10) || regex), 1, 16) AS template_version FROM cat"""


@oracle("template_stats_long")
def _():
    return with_(*mined_ctes("log_events"), f"""g AS (SELECT tenant, template_id,
  count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 10 MINUTES AND ts <= {AS_OF}) AS c10,
  count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 60 MINUTES AND ts <= {AS_OF}) AS c60,
  count(*) FILTER (WHERE ts > {AS_OF} - INTERVAL 1440 MINUTES AND ts <= {AS_OF}) AS c1440
  FROM mined WHERE NOT from_fallback GROUP BY tenant, template_id)""") + f"""
SELECT * FROM (
  SELECT tenant, template_id, '10m' AS window, c10 AS count, {AS_OF} AS updated_at FROM g
  UNION ALL SELECT tenant, template_id, '1h', c60, {AS_OF} FROM g
  UNION ALL SELECT tenant, template_id, '24h', c1440, {AS_OF} FROM g) WHERE count > 0"""


@oracle("catalog_by_dimension")
def _():
    day = f"({AS_OF} - INTERVAL 24 HOURS)"
    return with_(*_catalog_ctes()) + f"""SELECT label_service AS service, label_severity AS severity,
  CAST(grouping(label_service, label_severity) AS BIGINT) AS gid, count(*) AS templates,
  count(*) FILTER (WHERE first_seen > {day}) AS new_24h,
  count(*) FILTER (WHERE first_seen <= {day} AND last_seen > {day}) AS updated_24h
FROM cat GROUP BY GROUPING SETS ((label_service), (label_severity), ())"""


@oracle("template_detail")
def _():
    return with_(*mined_ctes("log_events"), """pm AS (SELECT template_id, epoch_us(ts) // 60000000 AS minute,
  count(*) AS n FROM mined WHERE NOT from_fallback GROUP BY ALL)""",
                 """d AS (SELECT template_id, sum(n) AS occurrences, count(*) AS active_minutes,
  max(n) AS peak_per_min, avg(n) AS mean_per_min FROM pm GROUP BY template_id)""",
                 """sp AS (SELECT pm.template_id, count(*) AS spike_minutes FROM pm JOIN d USING (template_id)
  WHERE pm.n > 2 * d.mean_per_min GROUP BY pm.template_id)""",
                 """ex AS (SELECT template_id, string_agg(message, chr(10) ORDER BY ts DESC, log_id DESC) AS examples
  FROM (SELECT template_id, message, ts, log_id, row_number() OVER (PARTITION BY template_id
        ORDER BY ts DESC, log_id DESC) AS rn FROM mined WHERE NOT from_fallback) WHERE rn <= 3
  GROUP BY template_id)""") + """SELECT d.template_id, CAST(occurrences AS BIGINT) AS occurrences,
  active_minutes, peak_per_min, round(mean_per_min, 6) AS mean_per_min,
  coalesce(spike_minutes, 0) AS spike_minutes, examples
FROM d LEFT JOIN sp USING (template_id) LEFT JOIN ex USING (template_id)"""


@oracle("new_templates")
def _():
    return with_(*mined_ctes("log_events"),
                 f"b AS (SELECT DISTINCT tenant, template_id FROM mined WHERE NOT from_fallback AND ts < {SPLIT})",
                 f"a AS (SELECT DISTINCT tenant, template_id FROM mined WHERE NOT from_fallback AND ts >= {SPLIT})") + \
        """SELECT tenant, template_id, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT tenant, template_id, 'vanished' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


@oracle("rate_delta")
def _():
    return with_(*mined_ctes("log_events"), f"""c AS (SELECT tenant, template_id,
  count(*) FILTER (WHERE ts < {SPLIT}) AS n_before, count(*) FILTER (WHERE ts >= {SPLIT}) AS n_after
  FROM mined WHERE NOT from_fallback GROUP BY tenant, template_id)""") + """SELECT tenant, template_id,
  n_before, n_after, n_after - n_before AS delta,
  CASE WHEN n_before > 0 THEN round(n_after / n_before, 6) END AS ratio FROM c"""


@oracle("template_events")
def _():
    return with_(*mined_ctes("log_events"), _cand(f"ts < {SPLIT}", "p"), _cand(f"ts >= {SPLIT}", "c")) + """,
j AS (SELECT c.tenant, c.template_id, c.n AS n_after, p.n AS n_before,
  CASE WHEN p.template_id IS NULL THEN 'NEW'
       WHEN substr(sha1(p.template_text || chr(10) || p.regex), 1, 16)
            <> substr(sha1(c.template_text || chr(10) || c.regex), 1, 16) THEN 'UPDATE'
       WHEN c.n >= 2.0 * p.n THEN 'SPIKE' END AS event_type
  FROM c LEFT JOIN p USING (tenant, template_id))
SELECT tenant, template_id, event_type, n_after, n_before, tenant || ':' || template_id AS partition_key
FROM j WHERE event_type IS NOT NULL"""


# ------------------------------------------------------------ jobs 7-8
from .oracle_sql import embed_ctes  # noqa: E402

CENTROIDS = """cen AS (SELECT CAST(label AS VARCHAR) AS query_id, list(v ORDER BY pos) AS qvec FROM (
  SELECT label, pos, avg(CAST(x AS DOUBLE)) AS v FROM (
    SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label)"""


@oracle("knn_cosine")
def _():
    return with_(CENTROIDS, """sc AS (SELECT query_id, CAST(vec_id AS VARCHAR) AS id,
  list_cosine_similarity(qvec, CAST(embedding AS DOUBLE[])) AS score FROM cen, embeddings)""") + """
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10"""


def _docs_cand():
    return mined_ctes("log_docs") + [_cand("TRUE", "dc")]


def _docs_vec_ctes():
    return _docs_cand() + ["dcs AS (SELECT tenant || chr(1) || template_id AS tid, * FROM dc)"] + \
        embed_ctes("dcs", "tid", "template_text", "tv")


@oracle("embed_templates")
def _():
    sums = ", ".join(f"round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(vec[{1 + 96 * i}:{96 * (i + 1)}], "
                     f"lambda x: x::DOUBLE)), lambda a, b: a + b), 5) AS q{i + 1}_sum" for i in range(4))
    return with_(*_docs_vec_ctes()) + f"""SELECT split_part(id, chr(1), 1) AS tenant,
  split_part(id, chr(1), 2) AS template_id, CAST(len(vec) AS BIGINT) AS dims, {sums} FROM tv"""


def _search_ctes(k: int, where: str = "TRUE") -> list[str]:
    return _docs_vec_ctes() + [
        "bq AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark WHERE length(trim(query)) > 0)"
    ] + embed_ctes("bq", "query_id", "query", "qv") + [
        f"""sc AS (SELECT qv.id AS query_id, tv.id AS id, split_part(tv.id, chr(1), 1) AS tenant,
  split_part(tv.id, chr(1), 2) AS template_id,
  list_cosine_similarity(CAST(qv.vec AS DOUBLE[]), CAST(tv.vec AS DOUBLE[])) AS score
  FROM qv, tv JOIN dcs ON dcs.tid = tv.id WHERE {where})""",
        f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM sc) WHERE rank <= {k})"""]


@oracle("knn_templates")
def _():
    return with_(*_search_ctes(10)) + \
        "SELECT query_id, tenant, template_id, round(score, 6) AS score, rank FROM hits"


@oracle("knn_filtered")
def _():
    return with_(*_search_ctes(5, "dcs.label_service = 'en'")) + \
        "SELECT query_id, tenant, template_id, round(score, 6) AS score, rank FROM hits"


@oracle("recency_rerank")
def _():
    end = "TIMESTAMP '2024-01-01 12:00:00'"
    return with_(*_search_ctes(10), f"""b AS (SELECT h.*, h.score + 0.05 / (1 + abs(epoch_us({end}) - epoch_us(dc.last_seen))
  / 3.6e9) AS boosted FROM hits h JOIN dc USING (tenant, template_id))""") + """SELECT query_id, tenant, template_id,
  rank, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS rerank,
  round(boosted, 6) AS boosted FROM b"""


@oracle("matched_tokens")
def _():
    tok = "'[\\p{L}\\p{Nd}_-]+'"
    uw = "'^" + UNI_WS + "+|" + UNI_WS + "+$'"
    return with_(*_search_ctes(10)) + f"""SELECT h.query_id, h.tenant, h.template_id,
  array_to_string(list_sort(list_intersect(
     list_distinct(regexp_extract_all(lower(regexp_replace(bq.query, {uw}, '', 'g')), {tok})),
     list_distinct(regexp_extract_all(lower(regexp_replace(dc.template_text, {uw}, '', 'g')), {tok})))), ' ')
  AS matched_tokens
FROM hits h JOIN dc USING (tenant, template_id) JOIN bq USING (query_id)"""


# ------------------------------------------------------------ job 9
def _esc(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\\\'), '\"', '\\\"')"


def _selector() -> str:
    parts = ", ".join(f"CASE WHEN coalesce(length({c}), 0) > 0 THEN '{k}=\"' || {_esc(c)} || '\"' END"
                      for k, c in (("service", "label_service"), ("env", "label_env")))
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ', ') || '}}'"


def _plan_ctes(k: int = 10) -> list[str]:
    return _search_ctes(k) + [f"""pl AS (SELECT h.query_id, h.rank, h.query_id || ':' || CAST(h.rank AS VARCHAR) AS plan_id,
  dc.label_service, dc.label_env, dc.regex, dc.template_text,
  {_selector()} || ' |~ "' || {_esc("CASE WHEN length(trim(dc.regex)) > 0 THEN trim(dc.regex) ELSE regexp_replace(dc.template_text, '[\\\\.+*?()|\\[\\]{{}}^$]', '\\\\\\0', 'g') END")} || '"' AS logql
  FROM hits h JOIN dc USING (tenant, template_id) WHERE h.rank <= 8)"""]


@oracle("logql_strings")
def _():
    return with_(*_plan_ctes()) + "SELECT query_id, rank, logql FROM pl"


@oracle("plan_execute")
def _():
    return with_(*_plan_ctes()) + """SELECT pl.query_id, norm.service, count(*) AS lines,
  count(DISTINCT plan_id) AS plans
FROM norm JOIN pl ON norm.service = pl.label_service AND norm.env = pl.label_env
WHERE regexp_matches(norm.message, pl.regex) GROUP BY ALL"""


@oracle("rate_by_service")
def _():
    return with_(LOG_EVENTS) + """SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, service,
  count(*) AS n, round(count(*) / 300.0, 6) AS rate FROM log_events GROUP BY ALL"""


@oracle("logql_forms")
def _():
    lf = (f"{_selector()} || ' |= \"' || {_esc('split_part(dc.template_text, chr(32), 1)')} || "
          "'\" | json | line_format \"{{.message}}\"'")
    return with_(*_search_ctes(3)) + f"""SELECT h.query_id, h.rank, {lf} AS line_filter,
  'sum(rate(' || {lf} || ' [5m])) by (service, severity)' AS rate_query
FROM hits h JOIN dc USING (tenant, template_id)"""


# ------------------------------------------------------------ jobs 1, 5, 10
TRIMWS = "'^[\\s\\x{85}\\x{A0}]+|[\\s\\x{85}\\x{A0}]+$'"


@oracle("label_parse")
def _():
    return with_(LOG_EVENTS, """s AS (SELECT log_id, '{service="' || service || '", env=' || env || ', ' || lower(severity)
  || ', tenant="' || tenant || '", env="' || env || '-x"}' AS s FROM log_events)""",
                 f"""p AS (SELECT log_id, list_transform(list_filter(string_split(regexp_replace(s, '^[{{}}]+|[{{}}]+$', '', 'g'), ','),
    lambda x: strpos(x, '=') > 0), lambda x: {{'k': regexp_replace(substr(x, 1, strpos(x, '=') - 1), {TRIMWS}, '', 'g'),
    'v': regexp_replace(regexp_replace(substr(x, strpos(x, '=') + 1), {TRIMWS}, '', 'g'), '^"+|"+$', '', 'g')}}) AS kv
  FROM s)""") + """SELECT log_id, array_to_string(list_sort(list_transform(
  list_filter(kv, lambda e, i: NOT list_contains(list_transform(kv[i + 1:], lambda z: z.k), e.k)),
  lambda e: e.k || '=' || e.v)), ';') AS labels FROM p"""


@oracle("push_roundtrip")
def _():
    return with_(LOG_EVENTS) + "SELECT ts, service, env, lower(severity) AS severity, payload FROM log_events"


@oracle("otlp_flatten")
def _():
    sevn = "CASE severity WHEN 'DEBUG' THEN 5 WHEN 'INFO' THEN 9 WHEN 'WARN' THEN 13 WHEN 'ERROR' THEN 17 END"
    return with_(LOG_EVENTS) + f"""SELECT ts, epoch_us(ts) * 1000 AS ts_nanos, array_to_string(list_sort([
  'env=' || env, 'scope.name=events', 'scope.version=1', 'service.name=' || service,
  'severity_number=' || CAST({sevn} AS VARCHAR), 'severity_text=' || severity,
  'span_id=' || substr(md5(CAST(log_id AS VARCHAR)), 1, 16), 'trace_id=' || md5('u' || CAST(log_id AS VARCHAR))]), ';')
  AS labels, payload FROM log_events"""


@oracle("json_batch_rejects")
def _():
    return with_(LOG_EVENTS, """b AS (SELECT tenant, epoch_us(ts) // 60000000 AS minute, count(*) AS n,
  bool_or(service = 'error') AS bad FROM log_events GROUP BY ALL)""") + """
SELECT 'accepted_records' AS reason, CAST(coalesce(sum(n) FILTER (WHERE NOT bad), 0) AS BIGINT) AS n FROM b
UNION ALL SELECT 'bad_json', count(*) FROM b WHERE bad"""


def _rfc3339(ts: str) -> str:
    return (f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' ELSE '.' || "
            f"rtrim(lpad(CAST(epoch_us({ts}) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z'")


def _kept_ctes():
    line = f"""'{{' || concat_ws(',',
    '"action":' || to_json(lower(action)),
    '"enforced":' || CASE WHEN shadow THEN 'false' ELSE 'true' END,
    CASE WHEN NOT shadow THEN '"keep_reason":' || to_json(keep_reason) END,
    CASE WHEN shadow THEN '"keep_reason_shadow":' || to_json(keep_reason) END,
    '"labels":{{"env":' || to_json(env) || ',"service":' || to_json(service) || ',"severity":'
      || to_json(lower(severity)) || ',"tenant":' || to_json(tenant) || '}}',
    '"message":' || to_json(message),
    '"policy_version":' || to_json(policy_version),
    CASE WHEN applied THEN '"redaction_applied":true' END,
    CASE WHEN applied THEN '"redaction_count":' || CAST(redaction_count AS VARCHAR) END,
    CASE WHEN applied THEN '"redaction_rules":' || to_json(rd_rules) END,
    '"sample_rate":' || CAST(sample_rate AS VARCHAR),
    CASE WHEN applied THEN '"sanitized":true' END,
    '"schema":' || to_json(schema),
    CASE WHEN shadow THEN '"shadow":true' END,
    '"template_id":' || to_json(template_id),
    '"ts":"' || {_rfc3339('ts')} || '"') || '}}'"""
    return [
        "en AS (SELECT *, severity IN ('FATAL', 'DEBUG') AS enforced FROM decided)",
        "kept AS (SELECT *, NOT enforced AS shadow FROM en WHERE NOT (enforced AND action = 'SUPPRESS'))",
        f"""ent AS (SELECT *, replace(replace(replace({line}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS line,
  'env=' || env || ',namespace=default,pod=unknown,service=' || service || ',severity=' || lower(severity) AS stream_key,
  epoch_us(ts) // 60000000 AS minute FROM kept)"""]


def _sink(sql: str) -> str:
    return _decided(Policy()) + ", " + ",\n".join(_kept_ctes()) + "\n" + sql


@oracle("enriched_lines")
def _():
    return _sink("SELECT log_id, line FROM ent")


@oracle("stream_keys")
def _():
    return _sink("SELECT stream_key, count(*) AS entries FROM ent GROUP BY ALL")


@oracle("active_streams")
def _():
    return _sink("SELECT count(DISTINCT stream_key) AS active_streams FROM ent")


def _greedy(minutes: int, max_entries: int, max_bytes: int) -> str:
    """Entry by entry, as the sink does it: the count and the bytes begin anew after each cut."""
    sql = _sink("SELECT 1")
    ctes = sql[:sql.rindex("SELECT 1")].rstrip()
    ctes = ctes if ctes.startswith("WITH RECURSIVE") else "WITH RECURSIVE" + ctes[4:]
    return ctes + f""",
o AS (SELECT stream_key, period, strlen(line) + 32 AS b, row_number() OVER (PARTITION BY stream_key, period ORDER BY ts, log_id) AS i
  FROM (SELECT *, CAST(epoch_us(ts) // CAST({60000000 * minutes} AS BIGINT) * {minutes} AS BIGINT) AS period FROM ent)),
f AS (SELECT stream_key, period, i, b, 0 AS chunk, 1 AS n, b AS total FROM o WHERE i = 1
  UNION ALL SELECT o.stream_key, o.period, o.i, o.b, CASE WHEN n >= {max_entries} OR total >= {max_bytes} THEN chunk + 1 ELSE chunk END,
    CASE WHEN n >= {max_entries} OR total >= {max_bytes} THEN 1 ELSE n + 1 END,
    CASE WHEN n >= {max_entries} OR total >= {max_bytes} THEN o.b ELSE total + o.b END
  FROM f JOIN o ON o.stream_key = f.stream_key AND o.period = f.period AND o.i = f.i + 1)
SELECT stream_key, period AS minute, CAST(chunk AS BIGINT) AS chunk, count(*) AS entries, sum(b) AS bytes FROM f GROUP BY ALL"""


@oracle("push_chunks")
def _():
    return _greedy(1, 5000, 1000000)


@oracle("push_chunks_cut")
def _():
    return _greedy(1440, 5, 900)


@oracle("redact_page_bodies")
def _():
    return with_(*normalized_ctes("log_bodies")) + "SELECT log_id, message, rules, redaction_count FROM norm"


@oracle("load_shed")
def _():
    return _sink("""SELECT lower(severity) AS severity, 'buffer_full' AS reason, count(*) AS dropped FROM (
  SELECT *, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, log_id) AS pos FROM ent)
WHERE pos > 1 AND lower(severity) = 'debug' GROUP BY ALL""")


def _en(sql: str) -> str:
    return _decided(Policy()) + ", en AS (SELECT *, severity IN ('FATAL', 'DEBUG') AS enforced FROM decided)\n" + sql


@oracle("sampling_metrics")
def _():
    rs = ", ".join(f"count(*) FILTER (WHERE action = 'KEEP' AND keep_reason = '{r}') AS kept_{r.lower()}"
                   for r in ["SEVERITY", "NOVEL", "SPIKE", "WARMUP", "LOG2", "BUDGET", "STEADYK"])
    return _en(f"""SELECT key_tenant, count(*) AS processed, count(*) FILTER (WHERE action = 'KEEP') AS kept,
  count(*) FILTER (WHERE action = 'SUPPRESS') AS suppressed, {rs},
  round(count(*) FILTER (WHERE action = 'KEEP') / count(*), 6) AS sample_rate FROM en GROUP BY key_tenant""")


@oracle("suppressed_rollup")
def _():
    return _en("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, key_tenant, template_id, key_service,
  key_env, severity, count(*) AS suppressed, sum(strlen(message)) AS bytes
FROM en WHERE enforced AND action = 'SUPPRESS' GROUP BY ALL""")


@oracle("tenant_volume")
def _():
    return _en("""SELECT key_tenant, count(*) AS lines, sum(strlen(payload)) AS bytes_in,
  sum(CASE WHEN action = 'KEEP' THEN strlen(payload) ELSE 0 END) AS bytes_kept,
  count(*) FILTER (WHERE action = 'KEEP') AS lines_kept,
  round(count(*) FILTER (WHERE action = 'KEEP') / count(*), 6) AS kept_ratio FROM en GROUP BY key_tenant""")


@oracle("records_by_schema")
def _():
    logfmt = q(P.LOGFMT_PAIR)
    bare = f"regexp_replace(payload, '^{UNI_WS}+|{UNI_WS}+$', '', 'g')"
    cls = f"""CASE WHEN starts_with({bare}, '{{') AND json_valid({bare}) THEN 'JSON'
            WHEN NOT starts_with({bare}, '{{') AND regexp_matches(payload, {logfmt}) THEN 'LOGFMT'
            ELSE 'TEXT' END"""
    return with_(LOG_DOCS, LOG_EVENTS, "u AS (SELECT payload FROM log_docs UNION ALL SELECT payload FROM log_events)") + \
        f"SELECT 'table' AS protocol, {cls} AS schema, count(*) AS records FROM u GROUP BY ALL"


@oracle("label_cardinality")
def _():
    return with_(LOG_EVENTS, """kv AS (SELECT 'tenant' AS k, tenant AS v FROM log_events
  UNION ALL SELECT 'service', service FROM log_events UNION ALL SELECT 'env', env FROM log_events
  UNION ALL SELECT 'severity', lower(severity) FROM log_events)""") + \
        "SELECT k, count(DISTINCT v) AS approx_distinct, count(*) AS rows FROM kv GROUP BY k"


@oracle("message_histogram")
def _():
    edges = [64, 256, 1024, 4096, 16384]
    b = "CASE " + " ".join(f"WHEN strlen(message) <= {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    le = "CASE " + " ".join(f"WHEN strlen(message) <= {e} THEN '{e}'" for e in edges) + " ELSE '+Inf' END"
    return with_(*normalized_ctes("log_docs")) + \
        f"SELECT service, CAST({b} AS BIGINT) AS bucket, {le} AS le, count(*) AS count FROM norm GROUP BY ALL"


@oracle("alerts")
def _():
    return with_(*mined_ctes("log_events"), """r AS (SELECT template_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start,
  count(*) AS n FROM mined GROUP BY ALL)""", """l AS (SELECT *, lag(n) OVER (PARTITION BY template_id ORDER BY window_start)
  AS prev_n FROM r)""") + """SELECT template_id, window_start, n, prev_n, round(n / prev_n, 6) AS ratio FROM l
WHERE n >= 3 AND (prev_n IS NULL OR n / prev_n >= 2.0)"""


@oracle("spike_topk")
def _():
    return with_(*counter_ctes("log_events")) + """SELECT key_tenant, window_start, template_id, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY key_tenant, window_start ORDER BY n DESC, template_id) AS rank FROM (
    SELECT key_tenant, time_bucket(INTERVAL 1 DAY, ts) AS window_start, template_id, count(*) AS n
    FROM sk GROUP BY ALL)) WHERE rank <= 3"""


@oracle("deploy_asof")
def _():
    return with_(*mined_ctes("log_events"),
                 "t AS (SELECT service, template_id, min(ts) AS first_seen FROM mined GROUP BY ALL)",
                 """d AS (SELECT service, min(ts) AS deployed_at, service || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS deploy_id
  FROM mined GROUP BY service, CAST(ts AS DATE))""") + """SELECT t.service, t.template_id, t.first_seen,
  d.deploy_id AS last_deploy, d.deployed_at AS last_deploy_at
FROM t ASOF LEFT JOIN d ON t.service = d.service AND t.first_seen >= d.deployed_at"""


@oracle("incident_keep")
def _():
    return with_(LOG_EVENTS, """inc AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS trace_id, ts - INTERVAL 1 HOUR AS s,
  ts + INTERVAL 1 HOUR AS e FROM events WHERE event_type = 'error' AND value >= 99)""",
                 """hit AS (SELECT DISTINCT l.log_id FROM log_events l JOIN inc
  ON inc.trace_id = 'u' || split_part(l.payload, ' ', 2) AND l.ts >= inc.s AND l.ts <= inc.e)""") + """
SELECT service, hit.log_id IS NOT NULL AS incident, count(*) AS records
FROM log_events LEFT JOIN hit USING (log_id) GROUP BY ALL"""


# ------------------------------------------------------------ remaining operators
@oracle("template_drift")
def _():
    return with_(*mined_ctes("log_events"), """f AS (SELECT CAST(len(string_split(template, ' ')) AS VARCHAR) || ':'
  || split_part(template, ' ', 1) AS leaf, template_id, min(ts) AS first_seen FROM mined WHERE NOT from_fallback
  GROUP BY ALL)""") + """SELECT leaf, template_id, first_seen,
  row_number() OVER (PARTITION BY leaf ORDER BY first_seen, template_id) AS version FROM f"""


@oracle("template_similarity")
def _():
    return with_(*mined_ctes("log_events"), _cand("TRUE", "ec"),
                 "t AS (SELECT tenant, template_id, template_text AS tpl, string_split(template_text, ' ') AS tk FROM ec)",
                 """p AS (SELECT a.tenant, a.template_id AS id_a, b.template_id AS id_b, a.tpl AS ta, b.tpl AS tb,
  a.tk AS ka, b.tk AS kb FROM t a JOIN t b ON a.tenant = b.tenant AND len(a.tk) = len(b.tk)
  AND a.template_id < b.template_id)""",
                 """h AS (SELECT *, list_sum(list_transform(range(1, len(ka) + 1),
  lambda i: CASE WHEN ka[i] = kb[i] THEN 0 ELSE 1 END)) AS hamming FROM p)""") + """SELECT tenant, id_a, id_b,
  round(levenshtein(ta, tb) / greatest(length(ta), length(tb), 1), 6) AS edit_norm,
  round(len(list_intersect(list_distinct(ka), list_distinct(kb))) / len(list_distinct(list_concat(ka, kb))), 6) AS jaccard,
  CAST(hamming AS BIGINT) AS hamming FROM h WHERE hamming <= 1"""


@oracle("refine_budget")
def _():
    return with_(LOG_DOCS) + """SELECT tenant, rn <= 60 AS refine_allowed, count(*) AS records FROM (
  SELECT tenant, row_number() OVER (PARTITION BY tenant, date_trunc('minute', ts) ORDER BY ts, log_id) AS rn
  FROM log_docs) GROUP BY ALL"""


@oracle("custom_templates")
def _():
    return with_(*mined_ctes("log_events")) + r"""SELECT custom_rule, CASE WHEN custom_rule IS NULL THEN template_id
  ELSE substr(sha1(tpl), 1, 16) END AS template_id, tpl AS template, count(*) AS records FROM (
  SELECT *, CASE WHEN regexp_matches(message, '^user \S+ purchase ') THEN 'purchase'
                 WHEN regexp_matches(message, ' error value=') THEN 'error' END AS custom_rule,
            CASE WHEN regexp_matches(message, '^user \S+ purchase ') THEN 'user <*> purchase <*>'
                 WHEN regexp_matches(message, ' error value=') THEN 'user <*> error value=<*>'
                 ELSE template END AS tpl FROM mined) GROUP BY ALL"""


@oracle("budget_k")
def _():
    return with_(LOG_EVENTS, """q AS (SELECT *, count(*) OVER (PARTITION BY tenant, epoch_us(ts) // 1000000) AS qps,
  CASE severity WHEN 'DEBUG' THEN 500 WHEN 'INFO' THEN 100 WHEN 'WARN' THEN 10 ELSE 100 END AS k FROM log_events)""") + \
        """SELECT tenant AS key_tenant, severity, CAST(CASE WHEN severity IN ('DEBUG', 'INFO')
  THEN k * greatest(1, ceil(qps / 0.5)) ELSE k END AS BIGINT) AS k_eff, count(*) AS records FROM q GROUP BY ALL"""


@oracle("template_browse")
def _():
    return with_(*_catalog_ctes(), "f AS (SELECT * FROM cat WHERE label_service = 'click')") + """SELECT tenant,
  template_id, last_seen, (SELECT count(*) FROM f) AS total, 5 + 20 < (SELECT count(*) FROM f) AS has_more
FROM f ORDER BY last_seen DESC, tenant, template_id LIMIT 20 OFFSET 5"""


@oracle("retain")
def _():
    return with_(LOG_EVENTS) + """SELECT tenant, count(*) AS records, min(ts) AS oldest FROM log_events
WHERE CASE tenant WHEN 't0' THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
                  WHEN 't1' THEN ts >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY ELSE TRUE END GROUP BY tenant"""


@oracle("publish_ack")
def _():
    return with_(*_docs_cand()) + "SELECT count(*) AS accepted, CAST(0 AS BIGINT) AS rejected, CAST(NULL AS VARCHAR) AS note FROM dc"


@oracle("vector_reembed")
def _():
    pid = ("CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(range(1, length(template_id) + 1), "
           "lambda i: CAST(ascii(substr(template_id, i, 1)) AS HUGEINT))), "
           "lambda acc, b: (acc * 31 + b) % 18446744073709551616) AS VARCHAR)")
    return with_(*_catalog_ctes(), """b AS (SELECT tenant, template_id, substr(sha1(template_text || chr(10) || regex), 1, 16)
  AS v FROM c_before)""", """a AS (SELECT tenant, template_id, substr(sha1(template_text || chr(10) || regex), 1, 16)
  AS template_version FROM cat)""") + f"""SELECT tenant, template_id, template_version, {pid} AS point_id
FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.tenant = a.tenant AND b.template_id = a.template_id
  AND b.v = a.template_version)"""


@oracle("promote_fields")
def _():
    kv = "'([A-Za-z0-9_.\\-]+)=(\"[^\"]*\"|[^\\t\\n\\f\\r \"]+)'"
    return with_(*normalized_ctes("log_events"), f"""f AS (SELECT unnest(regexp_extract_all(payload, {kv}, 1)) AS k,
  regexp_replace(unnest(regexp_extract_all(payload, {kv}, 2)), '^"|"$', '', 'g') AS v FROM norm WHERE schema = 'LOGFMT')""") + \
        "SELECT k, count(*) AS records, count(DISTINCT v) AS values FROM f GROUP BY k"


@oracle("oversize_rejects")
def _():
    return """SELECT 'too_large' AS reason, count(*) AS rejected FROM pages WHERE strlen(html) > 16384
UNION ALL SELECT 'accepted', count(*) FROM pages WHERE strlen(html) <= 16384"""


@oracle("redact_pages")
def _():
    return with_(*normalized_ctes("log_pages")) + \
        "SELECT log_id, schema, message, rules, redaction_count FROM norm"


# ------------------------------------------------------------ ties, tenants, losses
@oracle("knn_ties")
def _():
    return with_(CENTROIDS, """sc AS (SELECT query_id, copy || '-' || vec_id AS id,
  round(list_cosine_similarity(qvec, CAST(embedding AS DOUBLE[])), 12) AS score
  FROM cen, embeddings, (VALUES ('a'), ('b'), ('c')) c(copy))""") + """
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10"""


@oracle("knn_tenant")
def _():
    return with_(*_search_ctes(5, "dcs.label_service = 'en' AND dcs.tenant = 'src' || CAST(CAST(qv.id AS INTEGER) % 20 AS VARCHAR)")) + \
        "SELECT query_id, tenant, template_id, round(score, 6) AS score, rank FROM hits"


@oracle("knn_no_match")
def _():
    return with_(*_search_ctes(5, "dcs.tenant = 'nobody'")) + \
        "SELECT query_id, tenant, template_id, round(score, 6) AS score, rank FROM hits"


@oracle("null_keys_decided")
def _():
    return with_(LOG_EVENTS) + f"""SELECT log_id % 7 = 0 AS untimed, log_id % 5 = 0 AS no_severity,
  CASE WHEN log_id % 7 = 0 THEN {q(P.FALLBACK_POLICY_VERSION)} ELSE {q(P.POLICY_VERSION)} END AS policy_version,
  count(*) AS records, count(*) FILTER (WHERE log_id % 7 <> 0) AS counted FROM log_events GROUP BY ALL"""


@oracle("merge_templates")
def _():
    return "WITH RECURSIVE " + with_(*mined_ctes("log_events"), _cand("TRUE", "ec"), """tk AS (
  SELECT tenant, template_id, string_split(template_text, ' ') AS t FROM ec)""", """near AS (
  SELECT a.tenant, a.template_id AS x, b.template_id AS y FROM tk a JOIN tk b
    ON a.tenant = b.tenant AND len(a.t) = len(b.t)
  WHERE list_sum(list_transform(range(1, len(a.t) + 1), lambda i: CASE WHEN a.t[i] = b.t[i] THEN 0 ELSE 1 END)) <= 1)""", """reach AS (
  SELECT tenant, template_id, template_id AS r FROM tk
  UNION SELECT reach.tenant, reach.template_id, near.y FROM reach JOIN near
    ON near.tenant = reach.tenant AND near.x = reach.r)""")[5:] + \
        "SELECT tenant, template_id, min(r) AS canonical_id FROM reach GROUP BY ALL"


@oracle("split_candidates")
def _():
    return with_(*mined_ctes("log_events"), """pairs AS (SELECT template_id, unnest(string_split(template, ' ')) AS tt,
    unnest(string_split(message, ' ')) AS mt, unnest(range(0, len(string_split(template, ' ')))) AS pos FROM mined
  WHERE len(string_split(template, ' ')) = len(string_split(message, ' ')))""") + """
SELECT template_id, CAST(pos AS INTEGER) AS pos, count(DISTINCT mt) AS distinct_values, count(DISTINCT mt) > 50 AS split
FROM pairs WHERE regexp_matches(tt, '^<[^<>]+>$') GROUP BY template_id, pos"""


@oracle("grouping_buckets")
def _():
    from .oracle_sql import mask_expr
    return with_(*normalized_ctes("log_events"), f"mk AS (SELECT *, {mask_expr('message')} AS masked FROM norm)", """g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS fresh FROM mk
  WINDOW w AS (PARTITION BY tenant, masked ORDER BY ts, log_id))""", """b AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY tenant, masked ORDER BY ts, log_id) AS BIGINT) AS bucket FROM g)""") + """
SELECT tenant, masked, bucket, count(*) AS size, min(ts) AS first_seen, max(ts) AS last_seen,
  array_to_string(list(message ORDER BY ts, log_id)[1:3], chr(10)) AS exemplars FROM b GROUP BY tenant, masked, bucket"""


@oracle("p95_spikes")
def _():
    return with_(*counter_ctes("log_events"), f"""pm AS (SELECT {KEYS}, cur_minute AS minute, count(*) AS n FROM sk GROUP BY ALL)""",
                 f"""al AS (SELECT *, min(minute) OVER (PARTITION BY {KEYS}) AS born FROM pm)""",
                 f"""mins AS (SELECT {KEYS}, minute, n, unnest(range(greatest(born, minute - 60), minute)) AS m FROM al)""",
                 f"""vals AS (SELECT mins.* EXCLUDE (m), coalesce(pm.n, 0) AS v FROM mins LEFT JOIN pm
   ON {" AND ".join(f"pm.{k} = mins.{k}" for k in KEYS.split(", "))} AND pm.minute = mins.m)""",
                 f"""pc AS (SELECT {KEYS}, minute, n, list_sort(list(v)) AS vs FROM vals GROUP BY ALL)""") + f"""
SELECT {KEYS}, minute, n, vs[CAST(ceil(len(vs) * 0.95) AS INTEGER)] AS p95, n > vs[CAST(ceil(len(vs) * 0.95) AS INTEGER)] AS spike
FROM pc WHERE n > vs[CAST(ceil(len(vs) * 0.95) AS INTEGER)]"""


@oracle("plan_wildcard")
def _():
    return with_(*_plan_ctes()) + """SELECT pl.query_id, norm.service, count(*) AS lines,
  count(DISTINCT plan_id) AS plans
FROM norm JOIN pl ON norm.env = pl.label_env
WHERE regexp_matches(norm.message, pl.regex) GROUP BY ALL"""


@oracle("schema_edges")
def _():
    return """SELECT case_id, count(*) AS records, CASE case_id WHEN 'tab' THEN 'JSON' WHEN 'twice' THEN 'JSON' WHEN 'behind' THEN 'TEXT'
  WHEN 'two' THEN 'TEXT' WHEN 'quotes' THEN 'TEXT' WHEN 'pair' THEN 'LOGFMT' ELSE 'TEXT' END AS schema
FROM events, (VALUES ('tab'), ('twice'), ('behind'), ('two'), ('quotes'), ('pair'), ('plain')) c(case_id) GROUP BY case_id"""


@oracle("source_rejects")
def _():
    return """SELECT reason, count(*) AS records FROM (
  SELECT CASE event_id % 4 WHEN 0 THEN 'bad_body' WHEN 1 THEN 'bad_utf8' END AS reason FROM events) WHERE reason IS NOT NULL GROUP BY reason"""


@oracle("otlp_edge")
def _():
    return """SELECT ts - INTERVAL 2 HOURS AS ts, event_type AS service, 'user ' || CAST(user_id AS VARCHAR) AS payload,
  count(*) AS records FROM events GROUP BY ALL"""


@oracle("rules_policy")
def _():
    return with_(LOG_EVENTS) + """SELECT CASE WHEN severity IN ('ERROR', 'FATAL') THEN 'KEEP'
  WHEN service = 'click' AND NOT env = 'prod' THEN 'SUPPRESS'
  WHEN tenant >= 't1' AND (service = 'view' OR service = 'signup') THEN 'KEEP' ELSE 'none' END AS action,
  count(*) AS records FROM log_events GROUP BY ALL"""


@oracle("vector_upsert")
def _():
    return with_(*mined_ctes("log_events"), _cand("TRUE", "c")) + """SELECT tenant, template_id, last_seen + CASE WHEN starts_with(template_id, '0') THEN
  INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS last_seen, CASE WHEN starts_with(template_id, '0') THEN 'new' ELSE 'old' END AS origin FROM c"""


@oracle("truncate_docs")
def _():
    fits = lambda x, n: (f"left({x}, list_max(list_filter(range(0, least(length({x}), {n}) + 1), "  # noqa: E731
                         f"lambda i: strlen(left({x}, i)) <= {n})))")
    return with_(LOG_DOCS, "x AS (SELECT log_id, payload || chr(65533) AS p FROM log_docs)") + \
        f"SELECT log_id, {fits('p', 40)} AS cut, {fits('right(p, 9)', 11)} AS tail FROM x"


@oracle("label_defaults")
def _():
    return with_(LOG_EVENTS) + """SELECT CASE WHEN log_id % 4 = 3 OR log_id % 3 = 0 THEN 'UNSPECIFIED' ELSE severity END AS severity,
  CASE WHEN log_id % 5 = 0 THEN 'default' ELSE tenant END AS tenant, count(*) AS records FROM log_events GROUP BY ALL"""


@oracle("stack_traces")
def _():
    return with_(LOG_EVENTS, """x AS (SELECT log_id, payload, CASE WHEN log_id % 2 = 0 THEN payload || chr(10) || chr(9) || 'at call1'
  || CASE WHEN log_id % 3 >= 1 THEN chr(10) || chr(9) || 'at call2' ELSE '' END || CASE WHEN log_id % 3 >= 2 THEN chr(10) || chr(9) || 'at call3' ELSE '' END
  || chr(10) || 'Caused by: x' ELSE payload END AS p FROM log_events)""") + """SELECT log_id, payload AS stack_head,
  CAST(CASE WHEN log_id % 2 = 0 THEN log_id % 3 + 2 ELSE 0 END AS BIGINT) AS stack_frames,
  CASE WHEN log_id % 2 = 0 THEN sha1(p) END AS stack_hash FROM x"""


@oracle("aligned_results")
def _():
    return """SELECT event_type AS service, CASE event_id % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 't2' ELSE 't3' END AS template_id,
  count(*) AS records FROM events GROUP BY ALL"""


@oracle("catalog_filtered")
def _():
    return with_(*_catalog_ctes()) + """SELECT tenant, template_id, first_seen, last_seen FROM cat
WHERE label_service IN ('click', 'error') AND label_env = 'prod' AND last_seen >= TIMESTAMP '2024-01-05' AND first_seen <= TIMESTAMP '2024-01-20'"""


@oracle("sink_files")
def _():
    return with_(LOG_EVENTS) + """SELECT tenant, CAST(ts AS DATE) AS date, count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS chars
FROM log_events GROUP BY ALL"""


@oracle("drain_fits")
def _():
    return with_(LOG_EVENTS) + """SELECT tenant, service, count(*) AS records, CAST(0 AS BIGINT) AS misfits, CAST(0 AS BIGINT) AS clusters_without_first
FROM log_events GROUP BY ALL"""


def _decisions_of(view: str, policy, where: str = "TRUE") -> str:
    return "WITH RECURSIVE " + with_(*decided_ctes(view, policy))[5:] + \
        f"SELECT log_id, action, keep_reason, sample_rate, note, policy_version FROM decided WHERE {where}"


@oracle("ladder_budget")
def _():
    from .registry import BUDGETED
    return _decisions_of("log_burst", BUDGETED)


@oracle("ladder_novelty_window")
def _():
    return _decisions_of("log_events", Policy(novelty_hours=24.0))


@oracle("ladder_by_tenant")
def _():
    from .registry import TENANT_POLICIES
    parts = [_decisions_of("log_events", p, f"key_tenant = '{t}'") for t, p in TENANT_POLICIES.items()]
    named = ", ".join(f"'{t}'" for t in TENANT_POLICIES)
    parts.append(_decisions_of("log_events", Policy(), f"key_tenant NOT IN ({named})"))
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


@oracle("ema_per_minute")
def _():
    same = " AND ".join(f"a.{k} = b.{k}" for k in KEYS.split(", "))
    return with_(*counter_ctes("log_events"), f"pm AS (SELECT {KEYS}, cur_minute AS minute, count(*) AS n FROM sk GROUP BY ALL)") + f"""
SELECT a.*, round(coalesce(sum(0.2::DOUBLE * b.n * pow(0.8::DOUBLE, a.minute - b.minute - 1)), 0), 6) AS baseline
FROM pm a LEFT JOIN pm b ON {same} AND b.minute < a.minute GROUP BY ALL"""


@oracle("template_spikes")
def _():
    cut = "TIMESTAMP '2024-01-11 00:00:00'"
    return with_(*mined_ctes("log_events"), _cand(f"ts < {cut}", "p"), _cand(f"ts >= {cut}", "c")) + """,
j AS (SELECT c.tenant, c.template_id, c.n AS n_after, p.n AS n_before,
  CASE WHEN p.template_id IS NULL THEN 'NEW'
       WHEN substr(sha1(p.template_text || chr(10) || p.regex), 1, 16)
            <> substr(sha1(c.template_text || chr(10) || c.regex), 1, 16) THEN 'UPDATE'
       WHEN c.n / 20.0 >= 1.5 * p.n / 10.0 THEN 'SPIKE' END AS event_type
  FROM c LEFT JOIN p USING (tenant, template_id))
SELECT tenant, template_id, event_type, n_after, n_before, tenant || ':' || template_id AS partition_key
FROM j WHERE event_type IS NOT NULL"""


@oracle("catalog_upsert_text")
def _():
    return with_(*mined_ctes("log_events"), _cand("TRUE", "c")) + """SELECT tenant, template_id,
  CASE WHEN template_id < '8' THEN 'new text' ELSE template_text END AS template_text,
  CASE WHEN template_id < '8' THEN least(first_seen, last_seen - INTERVAL 40 DAYS) ELSE first_seen END AS first_seen, last_seen FROM c"""


# ------------------------------------------------------------ committed tables, indexes, time ranges
@oracle("catalog_commits")
def _():
    return with_(*mined_ctes("log_events"), _cand("TRUE", "cat")) + """SELECT tenant, template_id, template_text, regex, label_service,
  label_env, label_severity, first_seen, last_seen,
  substr(sha1(template_text || chr(10) || regex), 1, 16) AS template_version FROM cat"""


@oracle("stats_commits")
def _():
    each = " UNION ALL ".join(f"""SELECT tenant, template_id, '{w}' AS w, count(*) AS n, {at} AS as_of FROM mined
  WHERE NOT from_fallback AND ts > {at} - INTERVAL {m} MINUTES AND ts <= {at} GROUP BY tenant, template_id"""
                             for at in ("TIMESTAMP '2024-01-30 00:00:00'", AS_OF) for w, m in (("10m", 10), ("1h", 60), ("24h", 1440)))
    return with_(*mined_ctes("log_events"), f"s AS ({each})") + """SELECT tenant, template_id, w AS "window",
  arg_max(n, as_of) AS count, max(as_of) AS updated_at FROM s GROUP BY tenant, template_id, w"""


ORACLE["knn_ann"] = ORACLE["knn_cosine"]
_RANGE = ("TIMESTAMP '2024-01-01 00:30:00'", "TIMESTAMP '2024-01-01 06:00:00'")


@oracle("knn_time_range")
def _():
    inside = f"dcs.label_service IN ('en', 'fr') AND dcs.last_seen >= {_RANGE[0]} AND dcs.first_seen <= {_RANGE[1]} AND CAST(qv.id AS INTEGER) % 3 <> 0"
    return with_(*_search_ctes(5, inside)) + "SELECT query_id, tenant, template_id, round(score, 6) AS score, rank FROM hits"


@oracle("hits_with_counts")
def _():
    at = "TIMESTAMP '2024-01-01 20:00:00'"
    return with_(*_search_ctes(10), f"""c AS (SELECT tenant, template_id, count(*) AS n FROM mined
  WHERE NOT from_fallback AND ts > {at} - INTERVAL 24 HOURS AND ts <= {at} GROUP BY tenant, template_id)""") + """SELECT query_id, h.tenant, h.template_id,
  rank, coalesce(c.n, 0) AS count_24h FROM hits h JOIN dc USING (tenant, template_id) LEFT JOIN c ON c.tenant = h.tenant AND c.template_id = h.template_id"""


@oracle("plan_execute_range")
def _():
    return with_(*_plan_ctes()) + f"""SELECT pl.query_id, norm.service, count(*) AS lines, count(DISTINCT plan_id) AS plans
FROM norm JOIN pl ON norm.service = pl.label_service AND norm.env = pl.label_env
WHERE regexp_matches(norm.message, pl.regex) AND norm.ts >= {_RANGE[0]} AND norm.ts <= {_RANGE[1]} GROUP BY ALL"""


ORACLE["plan_indexed"] = ORACLE["plan_execute_range"]


@oracle("null_rows_everywhere")
def _():
    return with_(LOG_EVENTS, """e AS (SELECT log_id, CASE WHEN log_id % 3 <> 0 THEN payload END AS payload, CASE WHEN log_id % 7 <> 0 THEN ts END AS ts,
  CASE WHEN log_id % 5 <> 0 THEN tenant END AS tenant FROM log_events)""") + """
SELECT 'utf8' AS operator, count(*) AS records, 0 AS marked FROM e
UNION ALL SELECT 'size', count(*), count(*) FILTER (WHERE strlen(payload) > 50) FROM e
UNION ALL SELECT 'templates', count(*), count(*) FILTER (WHERE payload IS NULL) FROM e
UNION ALL SELECT 'not_blank', count(*), count(*) FILTER (WHERE tenant IS NULL) FROM e WHERE payload IS NOT NULL
UNION ALL SELECT 'retained', count(*), count(*) FILTER (WHERE ts IS NULL) FROM e WHERE tenant IS DISTINCT FROM 't0' OR ts IS NULL OR ts >= TIMESTAMP '2024-01-24 00:00:00'
UNION ALL SELECT 'mined_once', count(*), count(*) FROM e
UNION ALL SELECT 'buckets', count(*), 0 FROM e
UNION ALL SELECT 'budget', count(*), count(*) FROM e"""


@oracle("publish_ack_rejects")
def _():
    return with_(*mined_ctes("log_events"), _cand("TRUE", "c"), """r AS (SELECT CASE WHEN substr(template_id, 1, 1) = '3' THEN 'missing template_id'
  WHEN substr(template_id, 1, 1) IN ('0', '1') THEN 'missing template_text' WHEN substr(template_id, 1, 1) = '2' THEN 'missing regex' END AS reason FROM c)""") + """
SELECT 'ack' AS kind, count(*) FILTER (WHERE reason IS NULL) AS accepted, count(reason) AS rejected, min(reason) AS note FROM r
UNION ALL SELECT 'reason', 0, count(*), reason FROM r WHERE reason IS NOT NULL GROUP BY reason"""


@oracle("signature_cache")
def _():
    return "WITH RECURSIVE " + with_(LOG_EVENTS, """r AS (SELECT tenant, 'user ' || service || ' ' || env AS template, ts FROM log_events)""",
                                     """e AS (SELECT tenant, template, min(ts) AS start FROM r GROUP BY ALL
  UNION ALL SELECT e.tenant, e.template, (SELECT min(ts) FROM r WHERE r.tenant = e.tenant AND r.template = e.template
    AND r.ts >= e.start + INTERVAL 2 DAY) FROM e WHERE e.start IS NOT NULL)""")[5:] + """
SELECT r.tenant, r.template, any_value(c.calls) AS calls, count(*) - any_value(c.calls) AS cached
FROM r JOIN (SELECT tenant, template, count(start) AS calls FROM e GROUP BY ALL) c USING (tenant, template) GROUP BY r.tenant, r.template"""


@oracle("ladder_qps")
def _():
    return _decided(TUNED) + """, q AS (SELECT *, CASE WHEN severity IN ('DEBUG', 'INFO') AND keep_reason IN ('STEADYK', 'BUDGET')
  THEN CAST(sample_rate * greatest(1, ceil(count(*) OVER (PARTITION BY key_tenant, epoch_us(ts) // 1000000) / 0.5)) AS BIGINT) ELSE sample_rate END AS k_eff FROM decided)
SELECT log_id, CASE WHEN keep_reason IN ('STEADYK', 'BUDGET') THEN CASE WHEN seq % k_eff = 0 THEN 'KEEP' ELSE 'SUPPRESS' END ELSE action END AS action,
  keep_reason, k_eff AS sample_rate, note, policy_version FROM q"""
