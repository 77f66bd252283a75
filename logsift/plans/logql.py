"""Job 9: hits -> query strings, and the DataFrame execution of those plans
(P1-P6, J5, A11).

The LogQL strings are produced for users of an external log store; the same
answers are computed here directly on the log tables: a selector + regex
match is an equi-join on the selector labels followed by ``rlike`` with the
plan's regex (J5), and ``sum(rate(...[5m])) by (...)`` is a tumbling-window
count / 300 (A11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.templates import template_regex

GO_QUOTE_META = "[\\\\.+*?()|\\[\\]{}^$]"


def escape_logql(c: Column) -> Column:
    """Backslash, then double quote."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def quote_meta(c: Column) -> Column:
    """Regex-quote a literal (metacharacters \\.+*?()|[]{}^$)."""
    return F.regexp_replace(c, GO_QUOTE_META, "\\\\$0")


def label_selector(labels: Column, keys: list[str] | None = None) -> Column:
    """``{service="a", env="b", namespace="c"}`` in that order, blank values
    skipped; no labels -> ``{}``."""
    keys = keys or P.SELECTOR_LABELS
    parts = F.array_compact(F.array(*[
        F.when(F.coalesce(F.length(labels[k]), F.lit(0)) > 0,
               F.concat(F.lit(f'{k}="'), escape_logql(labels[k]), F.lit('"'))) for k in keys]))
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def plan(selected: DataFrame, max_templates: int = P.MAX_TEMPLATES_IN_PLAN,
         order_col: str = "rank", group_col: str = "query_id") -> DataFrame:
    """First ``max_templates`` selections per query ->
    ``<selector> |~ "<escaped regex>"``; blank regex -> regex-quoted template."""
    w = Window.partitionBy(group_col).orderBy(order_col)
    s = selected.withColumn("__pos", F.row_number().over(w)).filter(F.col("__pos") <= max_templates)
    rx = F.when(F.length(F.trim(F.col("regex"))) > 0, F.trim(F.col("regex"))) \
        .otherwise(quote_meta(F.col("template_text")))
    return s.withColumn("logql", F.concat(label_selector(F.col("labels")), F.lit(' |~ "'),
                                          escape_logql(rx), F.lit('"'))).drop("__pos")


def line_filter_query(labels: Column, literal: Column) -> Column:
    """Literal line filter with json stage."""
    return F.concat(label_selector(labels), F.lit(' |= "'), escape_logql(literal),
                    F.lit('" | json | line_format "{{.message}}"'))


def rate_query(labels: Column, literal: Column, by: list[str] = ("service", "severity"),
               window: str = "5m") -> Column:
    """``sum(rate(<line filter> [5m])) by (...)``."""
    return F.concat(F.lit("sum(rate("), line_filter_query(labels, literal), F.lit(f" [{window}])) by ("),
                    F.lit(", ".join(by)), F.lit(")"))


def alternation_query(selected: DataFrame, group_col: str = "query_id") -> DataFrame:
    """One query per group: ``{service=~"a|b"} |~ "r1|r2"`` over its selections
    (bounded by the plan limit, so the per-group list is small)."""
    g = selected.groupBy(group_col).agg(
        F.array_sort(F.collect_set(F.col("labels")["service"])).alias("__svc"),
        F.array_sort(F.collect_set(F.col("regex"))).alias("__rx"))
    return g.select(group_col, F.concat(
        F.lit('{service=~"'), escape_logql(F.array_join("__svc", "|")), F.lit('"} |~ "'),
        escape_logql(F.array_join(F.transform("__rx", lambda r: F.concat(F.lit("(?:"), r, F.lit(")"))), "|")),
        F.lit('"')).alias("logql"))


def plan_anchor(template: Column) -> Column:
    """Longest literal *middle* token of a template (no placeholder), or null.

    The plan regex escapes every literal and keeps single spaces, so a middle
    literal token t only matches as `` t `` - i.e. as a whole space-delimited
    token of a whitespace-canonical message. Joining on it is an exact
    prefilter: no matching line is lost."""
    toks = F.split(template, " ")
    middle = F.slice(toks, 2, F.greatest(F.size(toks) - 2, F.lit(0)))
    lit = F.filter(middle, lambda t: ~t.rlike("<[^<>]+>") & (F.length(t) > 0))
    ranked = F.array_sort(lit, lambda a, b: F.when(F.length(a) > F.length(b), -1)
                          .when(F.length(a) < F.length(b), 1)
                          .when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.get(ranked, F.lit(0))


def plan_literal(template: Column, regex: Column) -> Column:
    """Longest piece of a template between placeholders. Every line that the template's own regex
    matches holds it, so it is looked for before the regex runs; with another regex it is empty, which any line holds."""
    pieces = F.split(template, "<[^<>]+>")
    longest = F.array_max(F.transform(pieces, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return F.when((regex == template_regex(template)) & ~template.contains("\\="), longest).otherwise("")


#: Up to so many distinct anchors are looked up inside a line's row, in so many slots.
MAX_ANCHORS, ANCHOR_SLOTS = 50_000, 4096
#: Plans with neither an anchor nor a label are tested so many at a time.
LOOSE_PLANS = 500


def tokens(message: Column) -> Column:
    """The distinct space-delimited tokens of a message."""
    return F.array_distinct(F.split(message, " "))


def with_anchors(lines: DataFrame, anchored: DataFrame) -> DataFrame:
    """Lines with ``__hits``, those of their tokens that are some plan's anchor. The anchors come as one
    array of hash slots (a scalar subquery, evaluated once), so a token is compared with the few of its slot."""
    slot = F.pmod(F.xxhash64("__anchor"), F.lit(ANCHOR_SLOTS)).cast("int")
    by = anchored.select("__anchor").distinct().groupBy(slot.alias("slot")).agg(F.collect_list("__anchor").alias("anchors"))
    by = by.agg(F.map_from_entries(F.collect_list(F.struct("slot", "anchors"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(ANCHOR_SLOTS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.array().cast("array<string>")))
    hits = F.filter(tokens(F.col("message")), lambda t: F.array_contains(F.get("__slots", F.pmod(F.xxhash64(t), F.lit(ANCHOR_SLOTS)).cast("int")), t))
    return lines.withColumn("__slots", by.select(every.alias("slots")).scalar()).withColumn("__hits", hits).drop("__slots")


def prepared_plans(plans: DataFrame, keys: list[str]) -> DataFrame:
    """A written table of plans with their anchor, which labels they name, and those labels."""
    from ..session import cut_lineage
    named = F.concat(*[F.when(F.length(F.trim(F.coalesce(F.col("labels")[k], F.lit("")))) > 0, "1").otherwise("0") for k in keys])
    return cut_lineage(plans.select("plan_id", "regex", plan_anchor(F.col("template_text")).alias("__anchor"),
                                    F.coalesce(plan_literal(F.col("template_text"), F.col("regex")), F.lit("")).alias("__literal"), named.alias("__named"),
                                    *[F.coalesce(F.col("labels")[k], F.lit("")).alias(f"__p_{k}") for k in keys]), "plans")


def lines_of(logs: DataFrame, keys: list[str], start=None, end=None) -> DataFrame:
    """(log_id, ts, message, labels as ``__l_`` columns) of the lines of a time range."""
    if start is not None:
        logs = logs.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        logs = logs.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return logs.select("log_id", "ts", "message", *[F.coalesce(F.col("labels")[k], F.lit("")).alias(f"__l_{k}") for k in keys])


def message_fits(message: Column, literal: Column, regex: Column) -> Column:
    """The regex, on messages that hold its literal: a regex of a row is compiled again for every plan it meets."""
    return F.when(F.contains(message, literal), F.rlike(message, regex)).otherwise(False)


def labels_fit(keys: list[str]) -> Column:
    """A label that a plan does not name matches anything."""
    fits = F.lit(True)
    for i, k in enumerate(keys):
        fits = fits & ((F.substring("__named", i + 1, 1) == "0") | (F.col(f"__l_{k}") == F.col(f"__p_{k}")))
    return fits


def execute_loose(lines: DataFrame, loose: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that satisfy plans without an anchor: an equi-join per set of named labels; plans
    that name none must be tested on every line, and travel with it as an array of
    ``LOOSE_PLANS`` plans at a time, not as a join."""
    cols = ["plan_id", "log_id", "ts", "message", *[F.col(f"__l_{k}").alias(k) for k in keys]]
    fits = message_fits(F.col("message"), F.col("__literal"), F.col("regex"))
    out = None
    for row in loose.groupBy("__named").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 2^labels rows
        own, parts = loose.filter(F.col("__named") == row["__named"]), []
        on = [F.col(f"__l_{k}") == F.col(f"__p_{k}") for i, k in enumerate(keys) if row["__named"][i] == "1"]
        if on:
            parts.append(lines.join(own, on).filter(fits))
        else:
            blocks = -(-row["n"] // LOOSE_PLANS)
            for n in range(blocks):
                some = own.where(F.pmod(F.xxhash64("plan_id"), F.lit(blocks)) == n)
                plans = some.agg(F.collect_list(F.struct("plan_id", "__literal", "regex")).alias("plans")).scalar()
                hit = F.transform(F.filter("__plans", lambda p: message_fits(F.col("message"), p["__literal"], p["regex"])), lambda p: p["plan_id"])
                parts.append(lines.withColumn("__plans", plans).withColumn("__hits", hit).drop("__plans").withColumn("plan_id", F.explode("__hits")))
        for p in parts:
            out = p.select(*cols) if out is None else out.unionByName(p.select(*cols))
    return out if out is not None else lines.limit(0).withColumn("plan_id", F.lit(None).cast("string")).select(*cols)


def execute_plan(logs: DataFrame, plans: DataFrame, start=None, end=None,
                 keys: list[str] | None = None) -> DataFrame:
    """J5 + P5: log lines that satisfy a plan: selector labels equal and the
    message matches the plan regex (``|~`` = partial match).

    A label a plan does not name matches anything. Plans are written once
    (they are bounded: max_templates per query). Plans with an anchor token
    (see ``plan_anchor``) meet the lines that hold it: a line is repeated for those of its tokens that
    are an anchor, mostly none, and joined on the token. The others meet lines on
    the labels they name (``execute_loose``). ``plans.token_index`` answers the same from an index."""
    keys = keys or P.SELECTOR_LABELS
    lines, plans = lines_of(logs, keys, start, end), prepared_plans(plans, keys)
    anchored = plans.filter(F.col("__anchor").isNotNull())
    cols = ["plan_id", "log_id", "ts", "message", *[F.col(f"__l_{k}").alias(k) for k in keys]]
    if anchored.select("__anchor").distinct().limit(MAX_ANCHORS + 1).count() <= MAX_ANCHORS:
        hits = with_anchors(lines, anchored)
    else:
        hits = lines.withColumn("__hits", tokens(F.col("message")))
    toks = hits.withColumn("__tok", F.explode("__hits")).drop("__hits")
    out = toks.join(anchored, F.col("__tok") == F.col("__anchor")).filter(labels_fit(keys) & message_fits(F.col("message"), F.col("__literal"), F.col("regex"))).select(*cols)
    return out.unionByName(execute_loose(lines, plans.filter(F.col("__anchor").isNull()), keys))


def rate(df: DataFrame, by: list[str], window: str = "5 minutes", seconds: int = 300) -> DataFrame:
    """Per tumbling window and label set, lines per second."""
    g = df.groupBy(F.window("ts", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("window_start"), *by, "n",
                    (F.col("n") / F.lit(float(seconds))).alias("rate"))


def list_templates(catalog: DataFrame, stats: DataFrame | None = None, filters: dict | None = None,
                   limit: int = 100, offset: int = 0) -> tuple[DataFrame, int, bool]:
    """Filter by labels (service, env, severity), newest first, page with
    offset/limit. Returns (page, total, has_more); total is one scalar count."""
    c = catalog
    for k, v in (filters or {}).items():
        c = c.filter(F.col("labels")[k] == F.lit(v))
    if stats is not None:
        s = stats.filter(F.col("window") == "24h").select("tenant", "template_id", F.col("count").alias("count_24h"))
        c = c.join(s, ["tenant", "template_id"], "left")
    total = c.count()
    page = c.orderBy(F.col("last_seen").desc(), "tenant", "template_id").offset(offset).limit(limit)
    return page, total, offset + limit < total
