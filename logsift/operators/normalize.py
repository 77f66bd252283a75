"""Job 2: raw_logs -> normalized_logs.

One wide projection: classify on the raw payload, byte-cap, canonicalize
whitespace, NFC (Arrow UDF on non-ASCII rows only), then the redaction fold.
No shuffle; the plan is a single narrow stage fused by whole-stage codegen
except for the Arrow NFC step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.redact import Rule, barrier, default_rules, redact_steps
from ..functions.text import (UNI_WS, UNI_WS_CHARS, canonical_ws, detect_schema, nfc, severity_label, tenant_of,
                              truncate_bytes)



def unicode_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(UNI_WS_CHARS))


def normalize_message(payload: Column, max_message_bytes: int = P.MAX_MESSAGE_BYTES,
                      use_nfc: bool = True) -> Column:
    """N2 -> N3 -> N4 on one column."""
    m = unicode_trim(canonical_ws(truncate_bytes(payload, max_message_bytes)))
    return nfc(m) if use_nfc else m


def normalize(df: DataFrame, max_message_bytes: int = P.MAX_MESSAGE_BYTES, profile: str = "code",
              rules: list[Rule] | None = None, now: Column | None = None,
              payload_col: str = "payload", use_nfc: bool = True) -> DataFrame:
    """Normalize + redact. Adds schema, message, truncated, original_length,
    redaction{applied,rules,count}, sanitized, tenant, severity, correlation_id."""
    rules = rules or default_rules(profile)
    p = F.col(payload_col)
    df = df.withColumn("schema", detect_schema(p))
    df = df.withColumn("original_length", F.octet_length(p).cast("int"))
    df = df.withColumn("truncated", F.octet_length(p) > max_message_bytes)
    # NFC reads its text several times, so the text is made once, behind a barrier.
    df = df.withColumn("__norm", barrier(normalize_message(p, max_message_bytes, use_nfc=False)))
    df = df.withColumn("__norm", nfc(F.col("__norm")) if use_nfc else F.col("__norm"))
    df = redact_steps(df, "__norm", rules, out_col="message").drop("__norm")
    df = df.withColumn("sanitized", F.col("redaction.applied"))
    if "ts" in df.columns and now is not None:
        df = df.withColumn("ts", F.coalesce(F.col("ts"), now))
    if "labels" in df.columns:
        if "tenant" not in df.columns:
            df = df.withColumn("tenant", tenant_of(F.col("labels")))
        if "severity" not in df.columns:
            df = df.withColumn("severity", severity_label(F.col("labels")))
        df = df.withColumn("correlation_id", F.coalesce(F.col("labels")["trace_id"],
                                                         F.col("labels")["correlation_id"]))
    return df


def default_ts(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Missing event time -> arrival time (``now`` injectable for tests)."""
    return df.withColumn("ts", F.coalesce(F.col("ts"), now if now is not None else F.localtimestamp()))


def drop_blank(df: DataFrame, col: str = "message") -> DataFrame:
    """Drop rows whose message is null or empty after trimming."""
    return df.filter(F.length(unicode_trim(F.coalesce(F.col(col), F.lit("")))) > 0)


def promote_fields(df: DataFrame, max_fields: int = P.MAX_FIELDS, src: str = "payload") -> DataFrame:
    """Bounded ``fields`` map from JSON objects or logfmt pairs."""
    p = F.col(src)
    js = F.from_json(p, "map<string,string>")
    kv_re = "([A-Za-z0-9_.\\-]+)=(\"[^\"]*\"|[^\\t\\n\\f\\r \"]+)"
    keys = F.regexp_extract_all(p, F.lit(kv_re), 1)
    vals = F.transform(F.regexp_extract_all(p, F.lit(kv_re), 2),
                       lambda v: F.regexp_replace(v, '^"|"$', ""))
    ents = F.arrays_zip(keys.alias("key"), vals.alias("value"))
    rev = F.reverse(ents)
    rkeys = F.transform(rev, lambda e: e["key"])
    dedup = F.reverse(F.filter(rev, lambda e, i: F.array_position(rkeys, e["key"]) == i + 1))
    lf = F.map_from_entries(F.slice(dedup, 1, max_fields))
    fields = (F.when(F.col("schema") == "JSON", js)
              .when(F.col("schema") == "LOGFMT", lf))
    capped = F.map_from_entries(F.slice(F.map_entries(fields), 1, max_fields))
    return df.withColumn("fields", capped)


def collapse_stack(df: DataFrame, src: str = "payload") -> DataFrame:
    """Multi-line stack traces -> first line, frame count, hash of full text."""
    p = F.col(src)
    lines = F.split(p, "\\r?\\n", -1)
    frame = "^[\\t ]+(at |File \"|\\.\\.\\. [0-9]+ more)|^Caused by: "
    frames = F.size(F.filter(lines, lambda l: l.rlike(frame)))
    return (df.withColumn("stack_head", F.element_at(lines, 1))
              .withColumn("stack_frames", frames)
              .withColumn("stack_hash", F.when(frames > 0, F.sha1(p))))


def utf8_policy(df: DataFrame, mode: str = "drop", src: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Validate on -> invalid rows rejected; off -> invalid bytes stripped. A null payload has no invalid bytes."""
    p = F.col(src)
    valid = F.coalesce(F.is_valid_utf8(p), F.lit(True))
    if mode == "drop":
        ok = df.filter(valid)
        bad = df.filter(~valid).select(
            F.to_json(F.struct(*df.columns)).alias("source_row"), F.lit("invalid_utf8").alias("reason"))
        return ok, bad
    fixed = df.withColumn("utf8_fixed", ~valid).withColumn(
        src, F.when(valid, p).otherwise(F.replace(F.make_valid_utf8(p), F.lit("�"), F.lit(""))))
    return fixed, df.sparkSession.createDataFrame([], "source_row string, reason string")


def reject_oversize(df: DataFrame, max_log_size: int = P.MAX_LOG_SIZE,
                    src: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Payload over max_log_size bytes -> rejects(reason='too_large'); a null payload has no size."""
    big = F.coalesce(F.octet_length(F.col(src)), F.lit(0)) > max_log_size
    bad = df.filter(big).select(F.to_json(F.struct(*[c for c in df.columns if c != "labels"])).alias("source_row"),
                                F.lit("too_large").alias("reason"))
    return df.filter(~big), bad


def redaction_summary(df: DataFrame) -> DataFrame:
    """Records redacted per rule."""
    return (df.select(F.explode("redaction.rules").alias("rule"))
              .groupBy("rule").agg(F.count(F.lit(1)).alias("records")))
