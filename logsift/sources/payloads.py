"""Job 1: payload sources -> raw_logs + rejects.

Each protocol is a JSON document per line/file/Kafka value; parsing is
``from_json`` with an explicit schema followed by ``explode``. Unknown-field
strictness (Spark ignores unknown JSON keys) is checked by parsing the same
text as ``map<string,string>`` and comparing key sets; failing documents go
to ``rejects`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import parse_label_string

RAW_COLS = ["ts", "labels", "payload", "format_hint", "protocol"]

RECORD_SCHEMA = ("struct<timestamp:string,labels:map<string,string>,payload:string,format_hint:string>")
JSON_BATCH_SCHEMA = f"struct<records:array<{RECORD_SCHEMA}>>"
RECORD_KEYS = ["timestamp", "labels", "payload", "format_hint"]

PUSH_SCHEMA = "struct<streams:array<struct<labels:string,entries:array<struct<ts:string,line:string>>>>>"
PUSH_STREAM_KEYS = ["labels", "entries"]
PUSH_ENTRY_KEYS = ["ts", "line"]

OTLP_SCHEMA = ("struct<resourceLogs:array<struct<"
               "resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,"
               "intValue:string,boolValue:boolean,doubleValue:double>>>>,"
               "scopeLogs:array<struct<scope:struct<name:string,version:string>,"
               "logRecords:array<struct<timeUnixNano:string,severityNumber:int,severityText:string,"
               "body:struct<stringValue:string>,traceId:string,spanId:string>>>>>>>")


def parse_ts(c: Column) -> Column:
    """RFC 3339 / ISO timestamp string -> TIMESTAMP_NTZ in UTC wall clock: the
    offset is taken off; a text that is no time gives null."""
    local = F.regexp_replace(c, "(Z|z|[+-][0-9]{2}:?[0-9]{2})$", "").try_cast("timestamp_ntz")
    part = lambda i: F.coalesce(F.regexp_extract(c, "T.*([+-])([0-9]{2}):?([0-9]{2})$", i), F.lit(""))
    number = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    minutes = (number(2) * 60 + number(3)) * F.when(part(1) == "-", -1).otherwise(1)
    return local - F.make_dt_interval(mins=minutes)


def bad_times(raw: Column, ts: Column) -> Column:
    """True where a time was given, but is none."""
    return (F.length(F.trim(F.coalesce(raw, F.lit("")))) > 0) & ts.isNull()


def _unknown_keys(path_arrays: list[tuple[Column, list[str]]]) -> Column:
    """True if any object at the given array paths has a key outside its allow list."""
    bad = F.lit(False)
    for arr, allowed in path_arrays:
        allowed_arr = F.array(*[F.lit(k) for k in allowed])
        bad = bad | F.coalesce(F.exists(arr, lambda o: F.size(F.array_except(F.map_keys(o), allowed_arr)) > 0),
                               F.lit(False))
    return bad


def read_json_batches(df: DataFrame, col: str = "value", strict: bool = True, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``{records:[RawLog]}`` documents -> raw_logs; a document with an
    unknown key (top level or record) is rejected whole with reason bad_json,
    an unparsable one with bad_body."""
    v = F.col(col)
    parsed = df.select(v.alias("__doc"), F.from_json(v, JSON_BATCH_SCHEMA).alias("__b"),
                       F.from_json(v, "map<string,string>").alias("__top"),
                       F.from_json(v, "struct<records:array<map<string,string>>>").alias("__raw"))
    bad_body = F.col("__b").isNull() | F.col("__top").isNull()
    unknown = F.size(F.array_except(F.map_keys("__top"), F.array(F.lit("records")))) > 0
    if strict:
        unknown = unknown | _unknown_keys([(F.col("__raw.records"), RECORD_KEYS)])
    reason = F.when(bad_body, "bad_body").when(unknown, "bad_json")
    parsed = parsed.withColumn("__reason", reason)
    rejects = parsed.filter(F.col("__reason").isNotNull()).select(F.col("__doc").alias("source_row"),
                                                                  F.col("__reason").alias("reason"))
    ok = parsed.filter(F.col("__reason").isNull()).select(F.explode("__b.records").alias("r"))
    raw = ok.select(parse_ts(F.col("r.timestamp")).alias("ts"), F.col("r.labels").alias("labels"),
                    F.col("r.payload").alias("payload"),
                    F.coalesce(F.col("r.format_hint"), F.lit("")).alias("format_hint"),
                    F.lit("json").alias("protocol"))
    return arrived(raw, now), rejects


def arrived(raw: DataFrame, now: Column | None) -> DataFrame:
    """A missing or unreadable event time becomes the arrival time, if one is given."""
    return raw if now is None else raw.withColumn("ts", F.coalesce(F.col("ts"), now.cast("timestamp_ntz")))


def flatten_push(df: DataFrame, col: str = "value", now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 + N16: streams x entries; labels parsed from the stream's label
    string; hint 'text'. Documents with unknown keys -> rejects(bad_json)."""
    v = F.col(col)
    raw = F.from_json(v, "struct<streams:array<struct<labels:string,entries:array<map<string,string>>>>>")
    streams_raw = F.from_json(v, "struct<streams:array<map<string,string>>>")
    p = df.select(v.alias("__doc"), F.from_json(v, PUSH_SCHEMA).alias("__p"), raw.alias("__r"),
                  streams_raw.alias("__s"), F.from_json(v, "map<string,string>").alias("__top"))
    unknown = (F.size(F.array_except(F.map_keys("__top"), F.array(F.lit("streams")))) > 0) | \
        _unknown_keys([(F.col("__s.streams"), PUSH_STREAM_KEYS)]) | \
        F.coalesce(F.exists("__r.streams", lambda s: F.exists(s["entries"], lambda e: F.size(
            F.array_except(F.map_keys(e), F.array(*[F.lit(k) for k in PUSH_ENTRY_KEYS]))) > 0)), F.lit(False))
    reason = F.when(F.col("__p").isNull() | F.col("__top").isNull(), "bad_body").when(unknown, "bad_json")
    p = p.withColumn("__reason", reason)
    rejects = p.filter(F.col("__reason").isNotNull()).select(F.col("__doc").alias("source_row"),
                                                             F.col("__reason").alias("reason"))
    s = p.filter(F.col("__reason").isNull()).select(F.explode("__p.streams").alias("s"))
    e = s.select(parse_label_string(F.col("s.labels")).alias("labels"), F.explode("s.entries").alias("e"))
    out = e.select(parse_ts(F.col("e.ts")).alias("ts"), "labels", F.col("e.line").alias("payload"),
                   F.lit("text").alias("format_hint"), F.lit("push").alias("protocol"))
    return arrived(out, now), rejects


def otlp_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """What ``flatten_otlp`` leaves out: documents that are not valid UTF-8
    (bad_utf8; the parser would hide it) or do not parse (bad_body)."""
    v = F.col(col)
    o = F.from_json(v, OTLP_SCHEMA)
    reason = F.when(~F.is_valid_utf8(v), "bad_utf8").when(v.isNull() | o.isNull() | o["resourceLogs"].isNull(), "bad_body")
    return df.select(v.alias("source_row"), reason.alias("reason")).filter("reason is not null")


def flatten_otlp(df: DataFrame, col: str = "value", max_labels: int = P.MAX_LABELS,
                 validate_utf8: bool = True, now: Column | None = None) -> DataFrame:
    """S3 + S8: resource -> scope -> record. Labels = string resource attributes
    (first ``max_labels``) + scope.name, scope.version, severity_number,
    severity_text, trace_id, span_id when non-empty; ns timestamps."""
    v = F.col(col)
    if validate_utf8:
        df = df.filter(F.is_valid_utf8(v))
    else:
        v = F.replace(F.make_valid_utf8(v), F.lit("\uFFFD"), F.lit(""))
    d = df.select(F.from_json(v, OTLP_SCHEMA).alias("o"))
    r = d.select(F.explode("o.resourceLogs").alias("r"))
    attrs = F.slice(F.filter("r.resource.attributes", lambda a: a["value"]["stringValue"].isNotNull()),
                    1, max_labels)
    # Of attributes with one key the last counts.
    attrs = F.transform(attrs, lambda a, i: F.named_struct(F.lit("key"), a["key"], F.lit("value"), a["value"], F.lit("i"), i))
    last = lambda xs: F.filter(xs, lambda a: ~F.exists(xs, lambda b: (b["key"] == a["key"]) & (b["i"] > a["i"])))
    attrs = F.element_at(F.transform(F.array(attrs), last), 1)
    base = F.map_from_entries(F.transform(attrs, lambda a: F.struct(a["key"], a["value"]["stringValue"])))
    s = r.select(base.alias("__base"), F.explode("r.scopeLogs").alias("s"))
    rec = s.select("__base", "s.scope", F.explode("s.logRecords").alias("l"))

    def opt(k, c):
        return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.create_map(F.lit(k), c))

    extras = [opt("scope.name", F.col("scope.name")), opt("scope.version", F.col("scope.version")),
              F.when(F.coalesce(F.col("l.severityNumber"), F.lit(0)) != 0,
                     F.create_map(F.lit("severity_number"), F.col("l.severityNumber").cast("string"))),
              opt("severity_text", F.col("l.severityText")), opt("trace_id", F.col("l.traceId")),
              opt("span_id", F.col("l.spanId"))]
    empty = F.create_map().cast("map<string,string>")
    reserved = ("scope.name", "scope.version", "severity_number", "severity_text", "trace_id", "span_id")
    labels = F.map_concat(F.map_filter("__base", lambda k, v: ~k.isin(*reserved)),
                          *[F.coalesce(x, empty) for x in extras])
    ns = F.col("l.timeUnixNano").cast("decimal(20,0)")
    ts = F.when(ns > 0, F.expr("timestampadd(MICROSECOND, CAST(div(CAST(l.timeUnixNano AS DECIMAL(20,0)), 1000) "
                                "AS BIGINT), TIMESTAMP_NTZ'1970-01-01 00:00:00')"))
    body = F.col("l.body.stringValue")
    out = rec.select(ts.alias("ts"), ns.cast("bigint").alias("ts_nanos"), labels.alias("labels"),
                     body.alias("payload"), F.lit("").alias("format_hint"), F.lit("otlp").alias("protocol"))
    return arrived(out, now)


def from_contract(df: DataFrame, max_batch: int = P.MAX_BATCH, batch_col: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """Pre-normalized contract rows re-enter normalization; batches with
    no records or more than ``max_batch`` records are rejected."""
    sizes = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("__n"))
    j = df.join(sizes, batch_col)
    bad = j.filter(F.col("__n") > max_batch).select(F.to_json(F.struct(F.col(batch_col))).alias("source_row"),
                                                    F.lit("batch_too_large").alias("reason")).distinct()
    ok = j.filter(F.col("__n") <= max_batch).drop("__n").withColumnRenamed("message", "payload") \
        .withColumn("protocol", F.lit("contract"))
    return ok, bad


def union_sources(*dfs: DataFrame) -> DataFrame:
    """One raw_logs frame from all protocol branches."""
    out = None
    for d in dfs:
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def route_protocol(content_type: Column, path: Column) -> Column:
    """Content-type -> otlp; path prefix /loki/ -> push; else json."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return (F.when(kind.contains("protobuf") | kind.contains("otlp") | kind.contains("octet-stream"), "otlp")
            .when(path.startswith("/loki/"), "push").otherwise("json"))


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per line from text files; gzip/bz2/zstd by extension."""
    return spark.read.text(path)
