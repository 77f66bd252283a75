"""M1 + M18: fixed-depth-tree log clustering (Drain, He et al., ICWS 2017).

The Drain tree only routes a message by (token count, first ``depth - 2``
tokens, digit-bearing tokens routed as ``<*>``); clusters never move between
leaves. So the leaves are independent and the job is:

1. de-duplicate messages per (tenant, context) -> one row per distinct
   message with its first (ts, log_id) and count (partial aggregation);
2. compute the leaf key natively;
3. ``groupBy(tenant, context, leaf).applyInPandas``: the sequential cluster
   match runs per leaf over distinct messages in first-occurrence order;
4. join the per-message result back to the rows.

``drain`` keeps the sequential order of a leaf and so reads a whole leaf in one
task; ``drain_parallel`` is the one for large inputs: it clusters masked texts
(so numbers and ids do not multiply them), deals each leaf into parts of bounded
size, clusters the parts on their own, then the clusters' templates again, and
so on until a leaf is one part. A leaf of one part is done, and only the others go on;
texts are shuffled once for it, equal ones of a batch as one row. When such a level merges nothing, every two parts
of a leaf meet in a task of bounded size: each template finds its best earlier one,
and templates join the one they found if that found none itself. So the end is a leaf
of one part, or one without two templates that Drain would merge. No cluster is ever evicted. Its clusters are
those of Drain run on the parts; they can differ from the sequential ones where
the order of arrival decides between two templates of equal similarity.

Approximations of ``drain`` (stated, not hidden): the global child limit is not
modelled (routing uses the true leading tokens), and the cluster limit with LRU
eviction applies per leaf instead of globally.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.templates import mask, template_id, template_regex
from .ordered import null_safe_join

WILDCARD = "<*>"


def leaf_key(message, depth: int = P.DRAIN_DEPTH):
    """Native leaf key: token count + first depth-2 tokens (digits -> <*>)."""
    toks = F.filter(F.split(F.trim(message), "[\\t\\n\\f\\r \\x0B]+"), lambda t: F.length(t) > 0)
    lead = F.transform(F.slice(toks, 1, max(depth - 2, 0)),
                       lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))
    return F.concat_ws("\u0001", F.size(toks).cast("string"), F.array_join(lead, "\u0001"))


def _similarity(template: list[str], tokens: list[str]) -> tuple[float, int]:
    same = params = 0
    for a, b in zip(template, tokens):
        if a == WILDCARD:
            params += 1
        elif a == b:
            same += 1
    return (same / len(template) if template else 1.0), params


def drain_leaf(messages: list[str], sim: float = P.DRAIN_SIM, max_clusters: int | None = P.DRAIN_MAX_CLUSTERS,
               clusters: OrderedDict[int, list[str]] | None = None, next_id: int = 0):
    """Sequential Drain over one leaf. Returns per message (cluster_no, online
    template, matched) and the final template per cluster. ``clusters`` (least recently
    used first) are those of earlier messages, and are brought up to date."""
    clusters = OrderedDict() if clusters is None else clusters
    out = []
    for msg in messages:
        toks = msg.split()
        best, best_sim, best_params = None, -1.0, -1
        for cid, tmpl in clusters.items():
            s, p = _similarity(tmpl, toks)
            if s > best_sim or (s == best_sim and p > best_params):
                best, best_sim, best_params = cid, s, p
        if best is not None and best_sim >= sim:
            tmpl = clusters[best]
            clusters[best] = [a if a == b else WILDCARD for a, b in zip(tmpl, toks)]
            clusters.move_to_end(best)
            out.append((best, " ".join(clusters[best]), True))
        else:
            cid = next_id
            next_id += 1
            clusters[cid] = list(toks)
            if max_clusters and len(clusters) > max_clusters:
                clusters.popitem(last=False)
            out.append((cid, " ".join(toks), False))
    final = {}
    for cid, t, _ in out:
        final[cid] = t
    for cid, tmpl in clusters.items():
        final[cid] = " ".join(tmpl)
    return out, final


def drain(df: DataFrame, sim: float = P.DRAIN_SIM, depth: int = P.DRAIN_DEPTH,
          max_clusters: int = P.DRAIN_MAX_CLUSTERS, context: list[str] = (), mode: str = "final",
          message_col: str = "message", tenant_col: str = "tenant") -> DataFrame:
    """Adds template, template_id, regex, confidence (0.9 matched / 0.5 new),
    drain_cluster per row. ``mode='online'`` gives the cluster's template at
    the time the message first arrived; ``'final'`` the cluster's last one."""
    from .templates import materialize
    keys = [tenant_col, *context]
    m = F.col(message_col)
    df = materialize(df)  # consumed by the de-duplication and the join-back
    nonblank = df.filter(F.length(F.trim(m)) > 0)
    distinct = nonblank.groupBy(*keys, m.alias("__msg")).agg(
        F.min(F.struct("ts", "log_id")).alias("__first"), F.count(F.lit(1)).alias("__n"))
    distinct = distinct.withColumn("__leaf", leaf_key(F.col("__msg"), depth))
    key_schema = ", ".join(f"`{k}` string" for k in keys)
    schema = (f"{key_schema}, __msg string, __cluster string, __online string, __final string, __matched boolean, "
              "__first_ts timestamp_ntz, __first_id bigint")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__first_ts", "__first_id"])
        res, final = drain_leaf(pdf["__msg"].tolist(), sim, max_clusters)
        leaf = pdf["__leaf"].iloc[0] if len(pdf) else ""
        out = pdf[[*keys, "__msg", "__first_ts", "__first_id"]].copy()
        out["__cluster"] = [f"{leaf}#{c}" for c, _, _ in res]
        out["__online"] = [t for _, t, _ in res]
        out["__final"] = [final[c] for c, _, _ in res]
        out["__matched"] = [b for _, _, b in res]
        return out

    flat = distinct.select(*[F.col(k).cast("string").alias(k) for k in keys], "__msg", "__leaf",
                           F.col("__first.ts").alias("__first_ts"), F.col("__first.log_id").alias("__first_id"))
    mined = flat.groupBy(*keys, "__leaf").applyInPandas(run, schema)
    tcol = "__online" if mode == "online" else "__final"
    j = null_safe_join(df.withColumn("__msg", m), mined, [*keys, "__msg"], "left")
    # The first row of a distinct message carries its online match flag; later
    # duplicates of the same message always match their cluster.
    j = j.withColumn("__is_first", (F.col("ts") == F.col("__first_ts")) & (F.col("log_id") == F.col("__first_id")))
    matched = F.when(F.col("__is_first"), F.col("__matched")).otherwise(F.lit(True))
    return (j.withColumn("template", F.col(tcol))
              .withColumn("template_id", template_id(F.col("template")))
              .withColumn("regex", template_regex(F.col("template"), "full"))
              .withColumn("confidence", F.when(F.col("template").isNull(), F.lit(0.0))
                          .when(matched, F.lit(P.CONFIDENCE_MATCH)).otherwise(F.lit(P.CONFIDENCE_NEW)).cast("float"))
              .withColumnRenamed("__cluster", "drain_cluster")
              .drop("__msg", "__online", "__final", "__matched", "__is_first", "__first_ts", "__first_id"))


def _folded(rows: pa.Table, group: list[str]) -> pa.Table:
    """One row for equal rows of ``group``, in the order of their first, with the least ``at`` and ``id`` and all of ``n``."""
    rows = rows.append_column("first", pa.array(np.arange(len(rows))))
    out = rows.group_by(group, use_threads=False).aggregate([("at", "min"), ("id", "min"), ("n", "sum"), ("first", "min")])
    return out.sort_by("first_min").select([*group, "at_min", "id_min", "n_sum"]).rename_columns([*group, "at", "id", "n"])


def _equal_texts(group: list[str], kinds: pa.Schema):
    """Equal texts of a batch as one row, so a frequent text is a row per batch in the task of its leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _folded(pa.Table.from_batches([batch]), [*group, "text"]).select(kinds.names).cast(kinds).to_batches()
    return run


def _cluster_parts(group: list[str], kinds: pa.Schema, sim: float):
    """Cluster rows that come group by group, equal texts together; one part (and what came with its end) is held at a
    time. Gives a row per text where ``kinds`` has a text, else one per template."""

    def order(rows: pa.Table) -> list[int]:
        at, no, text = (rows[c].to_pylist() for c in ("at", "id", "text"))
        return sorted(range(len(text)), key=lambda i: (at[i] is not None, at[i], no[i] is not None, no[i], text[i]))

    def clustered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _folded(rows, [*group, "text"])
        texts = rows["text"].to_pylist()
        templates = [" ".join(t.split()) for t in texts]
        keys = [*zip(*(rows[c].to_pylist() for c in group), strict=True)]
        ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for lo, hi in zip([0, *ends], [*ends, len(keys)], strict=True):
            if hi - lo > 1:
                turn = order(rows.slice(lo, hi - lo))
                res, final = drain_leaf([texts[lo + i] for i in turn], sim, None)
                for i, (c, _, _) in zip(turn, res, strict=True):
                    templates[lo + i] = final[c]
        rows = rows.append_column("template", pa.array(templates, pa.string()))
        rows = rows if "text" in kinds.names else _folded(rows.drop_columns(["text"]), [*group, "template"])
        return rows.select(kinds.names).cast(kinds).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]).select([*group, "text", "at", "id", "n"])
            rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            if not len(rows):
                continue
            last = [rows[c] for c in group]
            own, first = [c[-1].as_py() for c in last], len(rows) - 1
            while first and all(c[first - 1].as_py() == v for c, v in zip(last, own, strict=True)):  # of the last group
                first -= 1
            if first:
                yield from clustered(rows.slice(0, first))
            held = _folded(rows.slice(first), [*group, "text"]).cast(rows.schema)
        if held is not None:
            yield from clustered(held)
    return run


def _partner_parts(group: list[str], kinds: pa.Schema, sim: float):
    """The best earlier template of each template, for rows that come group by group, in order; one group is held at a time."""
    names = kinds.names

    def flush(rows: list[dict]) -> list[dict]:
        number: dict[str, int] = {WILDCARD: 0}
        tokens = np.array([[number.setdefault(t, len(number)) for t in r["text"].split()] for r in rows])
        fixed, out = tokens != 0, []
        params = (~fixed).sum(axis=1)
        for i in range(1, len(rows)):
            same = ((tokens[:i] == tokens[i]) & fixed[:i]).sum(axis=1)
            most = same.max()
            if most / tokens.shape[1] >= sim:
                best = np.flatnonzero(same == most)
                r = rows[best[np.argmax(params[best])]]
                out.append({**rows[i], "same": int(most), "params": int(params[best].max()), "root_at": r["at"], "root_id": r["id"], "root": r["text"]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in group)
                if held and own != key:
                    out += flush(held)
                    held = []
                key = own
                held.append(row)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in out], kinds)
        if held:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in names} for r in flush(held)], kinds)
    return run


def _stars(level: DataFrame, keys: list[str], sim: float, part_rows: int) -> DataFrame:
    """Templates (with root and part) of leaves of several parts that merge: each with the best earlier one of its whole leaf."""
    from pyspark.sql.pandas.types import to_arrow_schema
    leaf = [*keys, "leaf"]
    sizes = level.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows)
    # Blocks of half a part, so a task of two blocks is as large as a part.
    blocks = F.ceil(2 * F.col("n") / part_rows)
    d = null_safe_join(level, sizes, leaf).withColumn("own", F.pmod(F.xxhash64("text"), blocks))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    d = d.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    group = [*leaf, "lo", "hi"]
    d = d.repartition(*group).sortWithinPartitions(*group, "at", "id", "text").select(*group, "at", "id", "text")
    kinds = d.select(*leaf, "text", "at", "id", F.lit(0).cast("long").alias("same"), F.lit(0).cast("long").alias("params"),
                     F.col("at").alias("root_at"), F.col("id").alias("root_id"), F.col("text").alias("root")).schema
    for f in kinds.fields:
        f.nullable = True
    met = d.mapInArrow(_partner_parts(group, to_arrow_schema(kinds), sim), kinds)
    best = F.min(F.struct(-F.col("same"), -F.col("params"), "root_at", "root_id", "root"))["root"]
    return met.groupBy(*leaf, "text").agg(best.alias("root"), F.min("at").alias("at"), F.min("id").alias("id"))


def _merge_stars(mates: DataFrame, level: DataFrame, keys: list[str], sim: float, part_rows: int) -> DataFrame:
    """(text, template) of templates and the roots they found; a root that has found one itself waits for the next time."""
    leaf = [*keys, "leaf"]
    ends = null_safe_join(mates, mates.select(*leaf, F.col("text").alias("root")), [*leaf, "root"], "left_anti")
    # The earliest child is in its root's part, so every star merges something.
    sizes = ends.groupBy(*leaf, "root").agg(F.ceil((F.count(F.lit(1)) + 1) / part_rows).alias("parts"),
                                            F.min(F.struct("at", "id", "text"))["text"].alias("first"))
    parts = F.when(F.col("text") == F.col("first"), F.lit(0)).otherwise(F.pmod(F.xxhash64("text"), F.col("parts")))
    children = null_safe_join(ends, sizes, [*leaf, "root"]).select(*leaf, "root", parts.cast("long").alias("part"), "text", "at", "id")
    roots = null_safe_join(level, sizes.select(*leaf, F.col("root").alias("text")), [*leaf, "text"]).select(
        *leaf, F.col("text").alias("root"), F.lit(0).cast("long").alias("part"), "text", "at", "id")
    return _clustered(children.union(roots).withColumn("n", F.lit(1).cast("long")), [*leaf, "root", "part"], sim, True).select(*leaf, "text", "template")


def _clustered(d: DataFrame, group: list[str], sim: float, each: bool) -> DataFrame:
    """Texts of a ``group`` clustered in one task: a row per text with its template, or one per template."""
    from pyspark.sql.pandas.types import to_arrow_schema
    d = d.repartition(*group).sortWithinPartitions(*group, "text")
    kinds = d.select(*group, *(["text"] if each else []), F.col("text").alias("template"), "at", "id", "n").schema
    for f in kinds.fields:
        f.nullable = True
    return d.mapInArrow(_cluster_parts(group, to_arrow_schema(kinds), sim), kinds)


def _large_leaves(level: DataFrame, leaf: list[str], part_rows: int) -> DataFrame | None:
    """Leaves of more than ``part_rows`` texts, with the parts they are dealt into; None if there is none."""
    from ..plans.guards import checked_broadcast
    from ..session import cut_lineage, forget
    # Rows are counted first, by a number per leaf, so texts are compared only where there can be so many.
    mark = F.xxhash64(*leaf).alias("mark")
    many = cut_lineage(level.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_rows).select("mark"), "marks", tight=True)
    sizes = None
    if not many.isEmpty():
        near = checked_broadcast(many, "marks")
        some = level.select(*leaf, "text", mark).join(many if near is None else near, "mark", "left_semi")
        sizes = some.groupBy(*leaf).agg(F.countDistinct(F.xxhash64("text")).alias("texts")).where(F.col("texts") > part_rows)
        sizes = cut_lineage(sizes.withColumn("parts", F.ceil(F.col("texts") / part_rows)), "sizes", tight=True)
        if sizes.isEmpty():
            forget(sizes)
            sizes = None
    forget(many)
    return sizes


def _dealt(level: DataFrame, sizes: DataFrame | None, leaf: list[str], alone: bool) -> DataFrame:
    """Texts with the parts of their leaf and their part; those that do not stand ``alone`` are made fewer here."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..plans.guards import checked_broadcast
    if sizes is None:
        d = level.withColumn("parts", F.lit(1).cast("long")).withColumn("part", F.lit(0).cast("long"))
    else:
        near = checked_broadcast(sizes, "sizes")
        d = null_safe_join(level, (sizes if near is None else near).drop("texts"), leaf, "left")
        d = d.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")))
    d = d.select(*leaf, "parts", "part", "text", "at", "id", "n")
    return d if alone else d.mapInArrow(_equal_texts([*leaf, "parts", "part"], to_arrow_schema(d.schema)), d.schema)


def drain_parallel(df: DataFrame, sim: float = P.DRAIN_SIM, depth: int = P.DRAIN_DEPTH, context: list[str] = (),
                   message_col: str = "message", tenant_col: str = "tenant", part_rows: int = 2000,
                   count_as: str | None = None) -> DataFrame:
    """Adds template, template_id, regex, confidence and drain_cluster (the
    template within its leaf) per row; blank messages get nulls and 0. No task
    holds more than about ``part_rows`` texts of a leaf. With ``count_as`` it gives
    one row per cluster, and one for the blank messages, with the number of its
    rows under that name in place of the rows and their confidence: rows are
    counted with their text and no text travels back to them."""
    from functools import reduce

    from ..session import cut_lineage, forget
    from .templates import materialize
    keys, each = [tenant_col, *context], count_as is None
    leaf = [*keys, "leaf"]
    m = F.trim(F.col(message_col))
    cut = lambda d, name: cut_lineage(d, name, tight=True)
    df = df.withColumn("__text", F.when(F.length(m) > 0, mask(m)))
    kinds, strings = df.select(*keys).schema, [F.col(k).cast("string").alias(k) for k in keys]
    if each:
        df = materialize(df)
    else:
        df = cut(df.select(*strings, "__text", leaf_key(F.col("__text"), depth).alias("__leaf"), "ts", "log_id"), "lines")
    lines = df.filter(F.col("__text").isNotNull())
    lines = lines.select(*strings, (leaf_key(F.col("__text"), depth) if each else F.col("__leaf")).alias("leaf"), F.col("__text").alias("text"),
                         F.col("ts").alias("at"), F.col("log_id").alias("id"), F.lit(1).cast("long").alias("n"))
    mins = [F.min("at").alias("at"), F.min("id").alias("id"), F.sum("n").alias("n")]
    # Where each row is asked for, ``done`` and ``found`` hold the template of every text, else the templates with their rows.
    kept, level, found, done = [*leaf, "text", "template"] if each else [*leaf, "template", "n"], lines, None, []

    def through(step: DataFrame, how: str, *more: str) -> DataFrame:
        """``found`` with the templates that its templates have come to."""
        new = null_safe_join(found.withColumnRenamed("template", "via"), step.select(*leaf, F.col("text").alias("via"), "template", *more), [*leaf, "via"], how)
        new = cut(new.select(*leaf, "text", F.coalesce("template", "via").alias("template"), *more), "clusters")
        forget(found)
        return new

    while True:
        sizes = _large_leaves(level, leaf, part_rows)
        step = cut(_clustered(_dealt(level, sizes, leaf, level is not lines), [*leaf, "parts", "part"], sim, each), "clusters")
        now = step if found is None or not each else through(step, "inner", "parts")
        done.append(now.where("parts = 1").select(*kept))
        if sizes is None:
            break
        texts = sizes.agg(F.sum("texts")).first()[0]
        before, level = level, cut(step.where("parts > 1").groupBy(*leaf, F.col("template").alias("text")).agg(*mins), "texts")
        merged = level.count() != texts
        if each:
            found = cut(now.where("parts > 1").select(*kept), "clusters")
        forget(sizes, None if before is lines else before)
        if not merged:  # by this deal; now every two parts of a leaf meet
            mates = cut(_stars(level.drop("n"), keys, sim, part_rows), "mates")
            if mates.isEmpty():
                forget(mates)
                done.append(found if each else level.withColumnRenamed("text", "template").select(*kept))
                break
            step = cut(_merge_stars(mates, level, keys, sim, part_rows), "clusters")
            found = through(step, "left") if each else None
            before, level = level, cut(null_safe_join(level, step, [*leaf, "text"], "left").groupBy(
                *leaf, F.coalesce("template", "text").alias("text")).agg(*mins), "texts")
            forget(before, mates, step)
    found = reduce(DataFrame.unionByName, done)
    cluster = F.when(F.col("template").isNotNull(), F.concat_ws("#", "__leaf", "template"))
    if each:
        found = found.withColumnRenamed("text", "__text").withColumnRenamed("leaf", "__leaf")
        firsts = null_safe_join(df, found, [*keys, "__text"], "left").withColumn("drain_cluster", cluster)
        born = firsts.filter(F.col("template").isNotNull()).groupBy(*keys, "drain_cluster").agg(F.min(F.struct("ts", "log_id")).alias("f"))
        born = born.select(*keys, "drain_cluster", F.col("f.ts").alias("ts"), F.col("f.log_id").alias("log_id"), F.lit(True).alias("__new"))
        out = null_safe_join(firsts, born, [*keys, "drain_cluster", "ts", "log_id"], "left")
    else:
        blank = cut(df.filter(F.col("__text").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as)), "blank")
        forget(df)  # the lines; their texts are in the templates now
        out = found.withColumnRenamed("n", count_as).withColumnRenamed("leaf", "__leaf").withColumn("drain_cluster", cluster).unionByName(
            blank, allowMissingColumns=True).withColumns({k: F.col(k).cast(kinds[k].dataType) for k in keys})
    out = out.withColumn("template_id", template_id(F.col("template"))).withColumn("regex", template_regex(F.col("template"), "full"))
    if not each:
        return out.drop("__leaf")
    return (out.withColumn("confidence", F.when(F.col("template").isNull(), F.lit(0.0)).when(F.col("__new"), F.lit(P.CONFIDENCE_NEW))
                           .otherwise(F.lit(P.CONFIDENCE_MATCH)).cast("float")).drop("__text", "__leaf", "__new"))
