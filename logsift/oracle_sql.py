"""DuckDB SQL equivalents of the registered queries (correctness oracle).

Patterns come from the same tables as the Spark code (``functions.patterns``)
in their RE2 form, so both engines cannot drift apart. The log views of
``sources.tables`` are re-declared here as CTEs over the driver tables.
"""

from __future__ import annotations

from .functions import patterns as P
from .functions.patterns import sql_str as q
from .functions.templates import ESCAPE_CLASS
from .operators.normalize import UNI_WS

# ---------------------------------------------------------------- log views
LOG_EVENTS = """log_events AS (
  SELECT event_id AS log_id, ts,
         't' || CAST(user_id % 3 AS VARCHAR) AS tenant,
         event_type AS service,
         CASE WHEN user_id % 2 = 0 THEN 'prod' ELSE 'dev' END AS env,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN'
                         WHEN 'signup' THEN 'INFO' ELSE 'DEBUG' END AS severity,
         concat_ws(' ', 'user', CAST(user_id AS VARCHAR), event_type,
                   'value=' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR),
                   'props=' || props) AS payload
  FROM events)"""

LOG_DOCS = """log_docs AS (
  SELECT doc_id * 1000000 + line_no AS log_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60 + line_no) AS ts,
         source AS tenant, lang AS service, 'prod' AS env, 'INFO' AS severity,
         payload, doc_id, line_no
  FROM (SELECT doc_id, lang, source,
               unnest(string_split(text, chr(10))) AS payload,
               CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS BIGINT) AS line_no
        FROM documents))"""

LOG_PAGES = """log_pages AS (
  SELECT page_id AS log_id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(page_id) AS ts,
         'web' AS tenant, 'crawler' AS service, 'prod' AS env, 'INFO' AS severity,
         'fetch ' || url || ' status=200 bytes=' || CAST(octet_length(encode(html)) AS VARCHAR) AS payload
  FROM pages)"""

LOG_BURST = """log_burst AS (SELECT event_id AS log_id, ts, 't' AS tenant, 's' AS service, 'e' AS env, 'DEBUG' AS severity, 'tick' AS payload FROM events)"""

LOG_BODIES = "log_bodies AS (SELECT page_id AS log_id, html AS payload FROM pages)"

VIEWS = {"log_events": LOG_EVENTS, "log_docs": LOG_DOCS, "log_pages": LOG_PAGES, "log_bodies": LOG_BODIES, "log_burst": LOG_BURST}


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------ expressions
def ws_norm(x: str) -> str:
    """N3 + Unicode trim + N4 (NFC)."""
    inner = f"trim(regexp_replace({x}, '[\\t\\n\\f\\r ]+', ' ', 'g'))"
    return f"nfc_normalize(regexp_replace({inner}, '^{UNI_WS}+|{UNI_WS}+$', '', 'g'))"


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[-\\t\\n\\f\\r ]', '', 'g')"
    digits = (f"list_sum(list_transform(range(length({d})), lambda j: "
              f"CASE WHEN j % 2 = 1 THEN (CASE WHEN 2 * CAST(substr({d}, length({d}) - j, 1) AS INTEGER) > 9 "
              f"THEN 2 * CAST(substr({d}, length({d}) - j, 1) AS INTEGER) - 9 "
              f"ELSE 2 * CAST(substr({d}, length({d}) - j, 1) AS INTEGER) END) "
              f"ELSE CAST(substr({d}, length({d}) - j, 1) AS INTEGER) END))")
    return f"(regexp_matches({d}, '^[0-9]{{13,19}}$') AND {digits} % 10 = 0)"


def redact_ctes(src: str, text_col: str, prefix: str = "rd") -> tuple[list[str], str]:
    """CTE chain applying the redaction fold. Final CTE has columns
    ``{prefix}_text, {prefix}_rules (list), {prefix}_count`` plus src columns."""
    ctes = []
    prev, cur = src, text_col
    mcols = []
    for i, (name, pat) in enumerate(P.REDACTION_RULES):
        m = f"regexp_extract_all({cur}, {q(pat)})"
        if name == "cc":
            m = f"list_filter({m}, lambda x: {luhn('x')})"
        ctes.append(f"{prefix}{i}m AS (SELECT *, {m} AS {prefix}_m{i} FROM {prev})")
        nxt = f"{prefix}_t{i + 1}"
        ctes.append(f"{prefix}{i} AS (SELECT *, list_reduce(list_prepend({cur}, {prefix}_m{i}), "
                    f"lambda acc, m: replace(acc, m, '<{name}>')) AS {nxt} FROM {prefix}{i}m)")
        mcols.append((name, f"{prefix}_m{i}"))
        prev, cur = f"{prefix}{i}", nxt
    rules = "list_filter([" + ", ".join(
        f"CASE WHEN len({m}) > 0 THEN '{n}' END" for n, m in mcols) + "], lambda x: x IS NOT NULL)"
    count = " + ".join(f"len({m})" for _, m in mcols)
    ctes.append(f"{prefix} AS (SELECT *, {cur} AS {prefix}_text, {rules} AS {prefix}_rules, "
                f"CAST({count} AS BIGINT) AS {prefix}_count FROM {prev})")
    return ctes, prefix


def normalized_ctes(view: str) -> list[str]:
    """``norm`` CTE: the view + schema + normalized, redacted message."""
    logfmt = q(P.LOGFMT_PAIR)
    bare = f"regexp_replace(payload, '^{UNI_WS}+|{UNI_WS}+$', '', 'g')"
    ctes = [VIEWS[view],
            f"""pre AS (SELECT *,
       CASE WHEN starts_with({bare}, '{{') AND json_valid({bare}) THEN 'JSON'
            WHEN NOT starts_with({bare}, '{{') AND regexp_matches(payload, {logfmt}) THEN 'LOGFMT'
            ELSE 'TEXT' END AS schema,
       {ws_norm('payload')} AS t0
     FROM {view})"""]
    rc, name = redact_ctes("pre", "t0")
    ctes += rc
    ctes.append(f"""norm AS (SELECT *, rd_text AS message, rd_count > 0 AS applied,
       array_to_string(rd_rules, ',') AS rules, rd_count AS redaction_count FROM {name})""")
    return ctes


def mask_expr(x: str, rules=None) -> str:
    out = x
    for pat, ph in (rules or P.MASK_RULES_BASIC):
        out = f"regexp_replace({out}, {q(pat)}, '{ph}', 'g')"
    return out


def template_id_expr(x: str) -> str:
    return f"substr(sha1({x}), 1, 16)"


def _escaped(ph: str) -> str:
    return "".join("\\" + ch if ch in P.ESCAPE_CHARS else ch for ch in ph)


def template_regex_expr(x: str) -> str:
    out = f"regexp_replace({x}, '{ESCAPE_CLASS}', '\\\\\\0', 'g')"
    for ph, rx in P.TEMPLATE_REGEX_CODE:
        out = f"replace({out}, {q(_escaped(ph))}, {q(rx)})"
    return f"replace(replace({out}, '\\ ', ' '), '\\=', '=')"


def signature_expr(x: str) -> str:
    toks = f"list_filter(string_split_regex(trim({x}), '[\\t\\n\\f\\r \\x0B]+'), lambda t: length(t) > 0)"
    case = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN '{n}'" for n, p in P.SIGNATURE_RULES) + " ELSE 'w' END"
    return f"array_to_string(list_transform({toks}[1:{P.SIGNATURE_MAX_TOKENS}], lambda t: {case}), ' ')"


def token_seq_expr(x: str) -> str:
    cur = x
    parts = []
    for pat, ph in P.MASK_RULES_BASIC:
        parts.append(f"list_transform(range(len(regexp_extract_all({cur}, {q(pat)}))), lambda i: '{ph}')")
        cur = f"regexp_replace({cur}, {q(pat)}, '{ph}', 'g')"
    return f"'token_seq:' || array_to_string(list_concat({', '.join(parts)})[1:{P.TOKEN_SEQ_MAX}], ',')"


def mined_ctes(view: str) -> list[str]:
    """``mined`` CTE: normalized + template columns + provenance/confidence."""
    blank = f"length(regexp_replace(message, '^{UNI_WS}+|{UNI_WS}+$', '', 'g')) = 0"
    return normalized_ctes(view) + [
        f"tm AS (SELECT *, CASE WHEN {blank} THEN NULL ELSE {mask_expr('message')} END AS template FROM norm)",
        f"""tm2 AS (SELECT *, template IS NULL AS from_fallback,
       CASE WHEN template IS NULL THEN 'missing' ELSE {template_id_expr('template')} END AS template_id,
       CASE WHEN template IS NULL THEN '.*' ELSE {template_regex_expr('template')} END AS regex,
       {signature_expr('message')} AS group_signature, {token_seq_expr('message')} AS token_seq FROM tm)""",
        """mined AS (SELECT *,
       CASE WHEN from_fallback THEN 'FALLBACK'
            WHEN row_number() OVER (PARTITION BY template_id ORDER BY ts, log_id) = 1 THEN 'HEURISTIC'
            ELSE 'CACHE' END AS provenance FROM tm2)"""]


KEYS = "key_tenant, template_id, key_service, key_env, severity"


def counter_ctes(view: str, inclusive: bool = True) -> list[str]:
    """``cnt`` CTE: mined rows + sampler key + seq, cur_min, windows, first_seen."""
    outs = ",\n       ".join(
        f"count(*) OVER (PARTITION BY {KEYS} ORDER BY cur_minute RANGE BETWEEN UNBOUNDED PRECEDING "
        f"AND {n + 1 if inclusive else n} PRECEDING) AS o_{name}" for n, name in
        [(10, "count_10m"), (60, "count_1h"), (1440, "count_24h")])
    return mined_ctes(view) + [
        """sk AS (SELECT *, coalesce(nullif(trim(tenant), ''), 'default') AS key_tenant,
       coalesce(nullif(trim(service), ''), '-') AS key_service,
       coalesce(nullif(trim(env), ''), '-') AS key_env,
       epoch_us(ts) // 60000000 AS cur_minute FROM mined)""",
        f"""c0 AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts, log_id) AS seq,
       row_number() OVER (PARTITION BY {KEYS}, cur_minute ORDER BY ts, log_id) AS cur_min,
       min(ts) OVER (PARTITION BY {KEYS}) AS key_first_seen,
       {outs} FROM sk)""",
        """cnt AS (SELECT *, seq - o_count_10m AS count_10m, seq - o_count_1h AS count_1h,
       seq - o_count_24h AS count_24h FROM c0)"""]


def ema_ctes(view: str, alpha: float) -> list[str]:
    """``em`` CTE (recursive): per-record EMA in arrival order per key."""
    r = 1.0 - alpha
    keq = " AND ".join(f"b.{k} = e.{k}" for k in KEYS.split(", "))
    return counter_ctes(view) + [
        f"""e AS (SELECT {KEYS}, seq, log_id, {alpha!r} * cur_min AS ema FROM cnt WHERE seq = 1
  UNION ALL
  SELECT b.key_tenant, b.template_id, b.key_service, b.key_env, b.severity, b.seq, b.log_id,
         {alpha!r} * b.cur_min + {r!r} * e.ema
  FROM e JOIN cnt b ON {keq} AND b.seq = e.seq + 1)""",
        "em AS (SELECT c.*, e.ema FROM cnt c JOIN e USING (log_id))"]


def ladder_sql(policy) -> str:
    """CASE ladder -> rung number; ``decided`` columns derive from it."""
    ks = " ".join(f"WHEN severity = '{s}' THEN {k or policy.steady_k_other}" for s, k in policy.steady_k.items())
    k = f"(CASE {ks} ELSE {policy.steady_k_other} END)"
    keep = ", ".join(f"'{s}'" for s in policy.severity_keep)
    over = (f"(count_10m > {policy.budget_10m} AND severity IN ('DEBUG', 'INFO'))"
            if policy.budget_10m > 0 else "FALSE")
    nov = "seq <= 1" if policy.novelty else "FALSE"
    log2 = "seq > 0 AND (seq & (seq - 1)) = 0" if policy.log2 else "FALSE"
    return f"""rung AS (SELECT *, {k} AS k, CASE
         WHEN severity IN ({keep}) THEN 1
         WHEN {nov} THEN 2
         WHEN epoch_us(ts) - epoch_us(key_first_seen) < {policy.novelty_hours * 3.6e9!r} THEN 10
         WHEN ema > 0 AND cur_min >= {policy.spike_factor!r} * ema AND cur_min >= {policy.min_spike} THEN 3
         WHEN seq <= {policy.warmup_n} THEN 4
         WHEN {log2} THEN 5
         WHEN {over} AND seq % {k} = 0 THEN 6
         WHEN {over} THEN 7
         WHEN seq % {k} = 0 THEN 8
         ELSE 9 END AS rung FROM em),
decided AS (SELECT *,
  CASE WHEN rung IN (7, 9) THEN 'SUPPRESS' ELSE 'KEEP' END AS action,
  CASE rung WHEN 1 THEN 'SEVERITY' WHEN 10 THEN 'NOVEL' WHEN 2 THEN 'NOVEL' WHEN 3 THEN 'SPIKE' WHEN 4 THEN 'WARMUP'
            WHEN 5 THEN 'LOG2' WHEN 6 THEN 'BUDGET' WHEN 7 THEN 'BUDGET' ELSE 'STEADYK' END AS keep_reason,
  CAST(CASE WHEN rung BETWEEN 6 AND 9 THEN k ELSE 1 END AS BIGINT) AS sample_rate,
  CASE rung WHEN 2 THEN 'first-occurrence' WHEN 10 THEN 'recent'
            WHEN 3 THEN printf('cur=%d ema=%.2f', cur_min, ema)
            WHEN 4 THEN printf('n=%d/{policy.warmup_n}', seq)
            WHEN 5 THEN printf('n=%d', seq)
            WHEN 6 THEN printf('budget>10m: %d>{policy.budget_10m}', count_10m)
            WHEN 7 THEN printf('budget>10m: %d>{policy.budget_10m}', count_10m)
            ELSE '' END AS note,
  '{policy.version}' AS policy_version FROM rung)"""


def decided_ctes(view: str, policy) -> list[str]:
    from .operators.sampling import ema_alpha
    return ema_ctes(view, ema_alpha(policy.half_life)) + [ladder_sql(policy)]


def _hu(x: str) -> str:
    return f"(('0x' || left(sha256({x}), 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"


def embed_ctes(src: str, id_col: str, text_col: str, name: str, dim: int = P.VECTOR_DIM) -> list[str]:
    """CTE ``name(id, vec FLOAT[])``: the same embedding as functions.embed."""
    qd = dim // 4
    p = name
    gram_n = f"CASE WHEN k < c2 THEN 2 WHEN k < c2 + c3 THEN 3 ELSE 4 END"
    gram_i = f"CASE WHEN k < c2 THEN k WHEN k < c2 + c3 THEN k - c2 ELSE k - c2 - c3 END"

    def pad(x):
        return f"list_concat(({x})[1:{qd}], list_transform(range(greatest({qd} - len({x}), 0)), lambda z: 0::FLOAT))"
    return [
        f"""{p}_a AS (SELECT {id_col} AS id, lower(regexp_replace({text_col}, '^{UNI_WS}+|{UNI_WS}+$', '', 'g')) AS t
  FROM {src})""",
        f"""{p}_b AS (SELECT id, t, hex(encode(t)) AS hx, octet_length(encode(t)) AS L,
  regexp_extract_all(t, '[\\p{{L}}\\p{{Nd}}_-]+') AS words FROM {p}_a)""",
        f"""{p}_w AS (SELECT id, list(c ORDER BY c DESC) AS counts FROM (
  SELECT id, w, count(*) AS c FROM (SELECT id, unnest(words) AS w FROM {p}_b) GROUP BY id, w) GROUP BY id)""",
        f"""{p}_c AS (SELECT b.*, coalesce(w.counts, []) AS counts, len(words) AS n,
  greatest(L - 1, 0) AS c2, greatest(L - 2, 0) AS c3, greatest(L - 3, 0) AS c4
  FROM {p}_b b LEFT JOIN {p}_w w USING (id))""",
        f"""{p}_d AS (SELECT id,
  list_transform(range(least(c2 + c3 + c4, {qd})),
    lambda k: {_hu(f"unhex(substr(hx, 2 * ({gram_i}) + 1, 2 * ({gram_n})))")}::FLOAT) AS p1,
  CASE WHEN n > 0 THEN list_concat([((list_sum(list_transform(words, lambda w: octet_length(encode(w))))::DOUBLE / n)
      / 20.0)::FLOAT], list_transform(counts[1:10], lambda c: (c / n)::FLOAT)) ELSE []::FLOAT[] END AS p2,
  list_concat(list_transform(counts, lambda c: (c / n)::FLOAT), [(ln(n + 1.0) / 10.0)::FLOAT]) AS p3,
  {_hu("encode(t)")} AS h FROM {p}_c)""",
        f"""{p}_e AS (SELECT id, list_concat({pad('p1')}, {pad('p2')}, {pad('p3')},
  list_transform(range({qd}), lambda i: (h * (i + 1) / {float(qd)})::FLOAT)) AS v FROM {p}_d)""",
        f"""{p}_f AS (SELECT id, v, list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: (x * x)::DOUBLE)),
  lambda a, b: a + b) AS ss FROM {p}_e)""",
        f"""{p} AS (SELECT id, CASE WHEN ss > 0 THEN list_transform(v, lambda x: x * (1.0 / sqrt(ss))::FLOAT)
  ELSE v END AS vec FROM {p}_f)"""]
