"""DuckDB SQL for the queries that SQL can express.

The language models, the network, alignments, trees and packing rounds have
none; tests hold them against plain versions instead.
"""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS o(k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits,
  CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
  CAST(length(regexp_replace(t, '[^.!?]', '', 'g')) AS BIGINT) AS n_ends
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 20 AS f0, 100 * n_repeat_words > 30 * n_words AS f1, 100 * n_symbols > 50 * n_words AS f2,
  100 * n_dup_lines > 30 * n_lines AS f3, word_chars < 2 * n_words AS f4, word_chars > 20 * n_words AS f5,
  100 * n_digits > 30 * word_chars AS f6, 100 * n_capitals > 60 * word_chars AS f7, n_words >= 200 AND n_ends = 0 AS f8,
  n_words > 10000000 AS f9 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed,
  NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5 OR f6 OR f7) AS kept,
  CAST(f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT + 32 * f5::INT + 64 * f6::INT + 128 * f7::INT
       + 256 * f8::INT + 512 * f9::INT AS BIGINT) AS fail_bits, n_lines, n_digits, n_capitals, n_ends FROM f"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM q),
win AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, q.n AS n, item FROM win JOIN q ON win.n = q.n AND win.s = q.s),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (r) LEFT JOIN it USING (r)"""

_RENDER = "array_to_string(list_transform({}, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')"
_MASK = ("array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN "
         "CAST(coalesce(list_sum(list_transform({0}[1:i - 1], lambda y: length(y.role) + length(y.text) + 13)), 0) + 14 AS VARCHAR) || ':' || "
         "CAST(coalesce(list_sum(list_transform({0}[1:i - 1], lambda y: length(y.role) + length(y.text) + 13)), 0) + 14 + length({0}[i].text) AS VARCHAR) "
         "END), lambda s: s IS NOT NULL), ',')")

OP10 = f"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS said FROM u GROUP BY conv_id),
g AS (SELECT *, row_number() OVER o AS k, first_value(conv_id) OVER o AS best FROM c
  WINDOW o AS (PARTITION BY turns[1].role, turns[1].text ORDER BY said DESC, conv_id)),
sib AS (SELECT 'sibling' AS kind, g.best AS chosen_id, g.conv_id AS rejected_id, b.turns AS ct, g.turns AS rt
  FROM g JOIN c b ON b.conv_id = g.best WHERE g.k > 1),
last AS (SELECT conv_id, turns, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS z,
  list_filter(turns, lambda x: x.role = 'assistant') AS a FROM c),
stale AS (SELECT 'stale' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, turns[1:z] AS ct,
  list_append(turns[1:z - 1], {{'turn': turns[z].turn, 'role': 'assistant', 'text': a[-2].text}}) AS rt FROM last WHERE len(a) >= 2),
p AS (SELECT * FROM sib UNION ALL SELECT * FROM stale),
s AS (SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(ct), len(rt)) + 1), lambda i: ct[i].role <> rt[i].role OR ct[i].text <> rt[i].text)) - 1,
  least(len(ct), len(rt))) AS INTEGER) AS n_shared FROM p),
x AS (SELECT *, ct[1:n_shared] AS pt, ct[n_shared + 1:] AS c2, rt[n_shared + 1:] AS r2 FROM s)
SELECT kind, chosen_id, rejected_id, n_shared, {_RENDER.format("pt")} AS prompt, {_RENDER.format("c2")} AS chosen,
  {_MASK.format("c2")} AS chosen_mask, {_RENDER.format("r2")} AS rejected, {_MASK.format("r2")} AS rejected_mask FROM x"""

_HOST = LOWER.format("coalesce(regexp_extract({}, '(?s)^.*?://([^/?#]*)', 1), '')")

OP1 = f"""
WITH p AS (SELECT page_id, html, {_HOST.format("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS rv FROM r),
l AS (SELECT host, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?((?:https?:)?//[^\\s"''<>]+)', 1)) AS u, page_id, row_number() OVER () AS k FROM v),
d AS (SELECT DISTINCT host, page_id, {_HOST.format("CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END")} AS dst FROM l),
pe AS (SELECT host AS src, dst, 1 + log2(count(*)) AS w FROM d GROUP BY ALL),
h AS (SELECT host FROM v UNION SELECT dst FROM pe),
t AS (SELECT host, substring(host, instr(host, '.') + 1) AS up FROM h WHERE host <> ''),
e AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM pe UNION ALL SELECT host, up, 1.0 FROM t WHERE instr(up, '.') > 0 AND up <> host
  UNION ALL SELECT up, host, 1.0 FROM t WHERE instr(up, '.') > 0 AND up <> host) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
w AS (SELECT walk, src, dst, w / sum(w) OVER (PARTITION BY walk, src) AS q FROM (
  SELECT 'trust' AS walk, src, dst, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e)),
c AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rv = 'allow') AS a, count(*) FILTER (WHERE rv = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
s0 AS (SELECT 'trust' AS walk, host, a AS x FROM c WHERE 2 * a > n UNION ALL SELECT 'distrust', host, b FROM c WHERE 2 * b > n),
s AS (SELECT walk, host, 0.5::DOUBLE * x / sum(x) OVER (PARTITION BY walk) AS r FROM s0),
r0 AS (SELECT * FROM s),
""" + ",\n".join(f"""r{i + 1} AS (SELECT walk, host, sum(r) AS r FROM (SELECT * FROM s UNION ALL
  SELECT w.walk, w.dst, r{i}.r * w.q * 0.5 FROM r{i} JOIN w ON w.walk = r{i}.walk AND w.src = r{i}.host) GROUP BY ALL)""" for i in range(10)) + """,
f AS (SELECT host, round(sum(CASE WHEN walk = 'trust' THEN r ELSE 0 END), 9) AS trust,
  round(sum(CASE WHEN walk = 'distrust' THEN r ELSE 0 END), 9) AS distrust FROM r10 GROUP BY host)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN distrust > 0.75 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM v LEFT JOIN f USING (host)"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS nl FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
tl AS (SELECT lang, count(*) AS v, sum(nl) AS nt FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(nt, 0) AS nt, coalesce(sum(n), 0) AS ns FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN tl USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.ns + 5 * g.v) AS p,
  1 + (1000000000::HUGEINT * (nl + 5)) // (g.nt + 5 * g.v) AS q
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50"""

OP12 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.r AS o, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, o) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10"""

OP13 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, substring(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32) AS id, length(text) AS chars FROM t),
c AS (SELECT conv_id, list({'id': id, 'chars': chars} ORDER BY turn NULLS FIRST, id) AS turns FROM k GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, sha256(array_to_string(list_transform(turns[1:d], lambda x: x.id), '')) AS key, CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars,
  len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY d, key),
u AS (SELECT n.d, n.key, a.d AS ad, a.key AS akey, n.n, n.chars, n.leaf FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d),
s AS (SELECT ad AS d, akey AS key, count(*) FILTER (WHERE leaf) AS n_leaves, count(*) FILTER (WHERE d = ad + 1) AS n_children,
  CAST(sum((n - 1) * chars) AS BIGINT) AS saved FROM u GROUP BY ad, akey)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, s.n_children, s.n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (d, key) LEFT JOIN p pp ON pp.conv_id = n.conv_id AND pp.d = n.d - 1 LEFT JOIN n up ON up.d = pp.d AND up.key = pp.key"""

ORACLE: dict[str, str] = {"op13_prefix_trie": OP13, "op12_pivot_search": OP12, "op11_source_divergence": OP11, "op1_url_trust": OP1, "op5_rule_ledger": OP5, "op8_position_index": OP8, "op10_preference_format": OP10}
