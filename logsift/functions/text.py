"""Column builders for normalization and label handling."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

# Runs of white space other than one space, which stays as it is.
_WS_RUN = "[\\t\\n\\f\\r][\\t\\n\\f\\r ]*| [\\t\\n\\f\\r ]+"
# White space that is trimmed from texts, as a class both regex engines know.
UNI_WS = "[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


UNI_WS_CHARS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LOGFMT_MIDDLE = "\\w[\\t\\n\\f\\r ]*=[\\t\\n\\f\\r ]*[^\\t\\n\\f\\r =]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def detect_schema(payload) -> Column:
    """JSON if trimmed payload starts with '{' and parses, else LOGFMT when it
    has a ``key = value`` pair and does not start with '{', else TEXT."""
    p = col_(payload)
    t = F.btrim(p, F.lit(UNI_WS_CHARS))
    is_obj = t.startswith("{")
    # As the one element of an array of raw texts: repeated keys are allowed, anything behind the object is not.
    one = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return (F.when(is_obj & (F.size(one) == 1), F.lit("JSON"))
            # A pair is found by its last key character and its first value character, in texts that have the sign.
            .when(~is_obj & p.contains("=") & p.rlike(LOGFMT_MIDDLE), F.lit("LOGFMT"))
            .otherwise(F.lit("TEXT")))


def canonical_ws(c) -> Column:
    """Runs of [\\t\\n\\f\\r ] become one space, then trim."""
    return F.trim(F.regexp_replace(col_(c), _WS_RUN, " "))


def truncate_bytes(c, max_bytes: int) -> Column:
    """Keep the first ``max_bytes`` UTF-8 bytes; a code point cut in half is
    dropped instead of producing invalid UTF-8."""
    s = col_(c)
    at = lambda n: F.substring(s.cast("binary"), 1, max(n, 0)).cast("string")
    # A code point has at most four bytes: one of these lengths ends on a boundary.
    cut = F.make_valid_utf8(at(max_bytes))
    for back in (3, 2, 1, 0):
        cut = F.when(F.is_valid_utf8(at(max_bytes - back)), at(max_bytes - back)).otherwise(cut)
    return F.when(F.octet_length(s) > max_bytes, cut).otherwise(s)


def is_truncated(c, max_bytes: int) -> Column:
    return F.octet_length(col_(c)) > max_bytes


@F.arrow_udf(T.StringType())
def _nfc_udf(s: pa.Array) -> pa.Array:
    if s.null_count == len(s):
        return s
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def nfc(c) -> Column:
    """NFC normalization. Only rows with a character from U+0300 on carry data into the
    Arrow UDF, as texts without one are in NFC; the others pass null and are restored by ``coalesce``."""
    s = col_(c)
    open_ = s.rlike("[^\\x{0}-\\x{2FF}]")
    return F.coalesce(_nfc_udf(F.when(open_, s)), s)


def normalize_severity(c) -> Column:
    """Case-insensitive severity label -> enum short name."""
    s = F.lower(F.trim(col_(c)))
    expr = F.when(F.lit(False), F.lit(None))
    for k, v in P.SEVERITY_NAMES.items():
        expr = expr.when(s == k, F.lit(v))
    return expr.otherwise(F.lit("UNSPECIFIED"))


def severity_label(labels) -> Column:
    """Severity taken from the label map: severity, severity_text, then level."""
    m = col_(labels)
    return normalize_severity(F.coalesce(m["severity"], m["severity_text"], m["level"]))


def nonblank(c) -> Column:
    return F.nullif(F.trim(col_(c)), F.lit(""))


def tenant_of(labels) -> Column:
    """Tenant label, then tenant_id, blank -> 'default'."""
    m = col_(labels)
    return F.coalesce(nonblank(m["tenant"]), nonblank(m["tenant_id"]), F.lit("default"))


def keep_labels(labels, allow: list[str]) -> Column:
    """Keep only allow-listed keys."""
    arr = F.array(*[F.lit(k) for k in allow])
    return F.map_filter(col_(labels), lambda k, v: F.array_contains(arr, k))


def policy_labels(labels) -> Column:
    return keep_labels(labels, P.POLICY_LABELS)


def catalog_labels(labels, allow: list[str] | None = None) -> Column:
    """Lower-case keys, keep the allow list; colliding keys keep the value of
    the greatest original key."""
    allow = allow or P.CATALOG_LABELS
    arr = F.array(*[F.lit(k) for k in allow])
    ents = F.filter(F.map_entries(col_(labels)), lambda e: F.array_contains(arr, F.lower(e["key"])))
    ents = F.array_sort(ents, lambda a, b: F.when(a["key"] < b["key"], -1)
                        .when(a["key"] > b["key"], 1).otherwise(0))
    lowered = F.transform(ents, lambda e: F.named_struct(F.lit("key"), F.lower(e["key"]), F.lit("value"), e["value"]))
    # Last occurrence of a lowered key wins: reverse, keep first per key.
    rev = F.reverse(lowered)
    keys = F.transform(rev, lambda e: e["key"])
    dedup = F.filter(rev, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(dedup)


def default_labels(labels, defaults: dict[str, str] | None = None) -> Column:
    """Fill absent or empty labels with sink defaults."""
    defaults = defaults or P.SINK_LABEL_DEFAULTS
    m = col_(labels)
    m = F.coalesce(m, F.create_map().cast("map<string,string>"))
    fill = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    missing = F.map_filter(fill, lambda k, v: F.coalesce(F.length(m[k]), F.lit(0)) == 0)
    kept = F.map_filter(m, lambda k, v: ~(F.array_contains(F.map_keys(missing), k)))
    return F.map_concat(kept, missing)


def _trim_space(c) -> Column:
    return F.regexp_replace(c, "^[\\s\\x{85}\\x{A0}]+|[\\s\\x{85}\\x{A0}]+$", "")


def parse_label_string(c) -> Column:
    """``{k="v", a=b}`` -> map. Strip brace characters at both ends, split
    on every comma, split each part at its first '=', trim spaces (and quotes
    from the value), skip parts without '=', last duplicate key wins."""
    s = F.regexp_replace(col_(c), "^[{}]+|[{}]+$", "")
    parts = F.filter(F.split(s, ","), lambda p: F.instr(p, "=") > 0)
    kv = F.transform(parts, lambda p: F.named_struct(
        F.lit("key"), _trim_space(F.substring_index(p, "=", 1)),
        F.lit("value"), F.regexp_replace(_trim_space(F.substring(p, F.instr(p, "=") + 1, F.lit(1 << 30))),
                                         '^"+|"+$', "")))
    rev = F.reverse(kv)
    keys = F.transform(rev, lambda e: e["key"])
    dedup = F.filter(rev, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(F.reverse(dedup)), F.create_map().cast("map<string,string>"))


def label_string(labels, keys: list[str] | None = None) -> Column:
    """Render a label map as ``{k="v", ...}`` sorted by key."""
    m = col_(labels)
    ents = F.array_sort(F.map_entries(m if keys is None else keep_labels(m, keys)))
    parts = F.transform(ents, lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
