"""Jobs 7-8: template vectors and semantic search.

Exact kNN without a cross join: queries are broadcast in blocks of bounded
bytes; each task scores the vectors that pass a block's filters with one matrix
product per filter (numpy, Arrow batches) and keeps a running top-k per query,
ties by id, for the whole partition. Only k rows per (query, partition) are
shuffled; the final top-k per query is a ``row_number() <= k`` window. With an
index (``operators.vector_index``) a query meets the vectors of a few lists only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.embed import embed, shared_tokens
from ..sinks.commits import Table

BLOCK_BYTES = 32 << 20  # of query vectors that are broadcast at a time
CELLS = 4 << 20  # scores a task computes at a time
HIT_SCHEMA = "query_id string, id string, score double"


def effective_k(k) -> int:
    """k <= 0 or k > 100 -> default 10 (replaced, not clamped)."""
    k = int(k) if k is not None else 0
    return P.TOP_K_DEFAULT if k <= 0 or k > P.TOP_K_MAX else k


def template_vectors(catalog: DataFrame, dim: int = P.VECTOR_DIM) -> DataFrame:
    """E8 + U4 payload: one vector per (tenant, template) of the catalog."""
    return catalog.select("tenant", "template_id", "template_version", "labels", "first_seen", "last_seen",
                          embed(F.col("template_text"), dim).alias("embedding"))


def needs_embedding(catalog: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Only templates whose (tenant, id, version) has no vector yet."""
    if vectors is None:
        return catalog
    have = vectors.select("tenant", "template_id", "template_version")
    return catalog.join(have, ["tenant", "template_id", "template_version"], "left_anti")


def upsert_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """U4: replace by (tenant, template_id) (tenant-scoped, unlike a bare id),
    keeping the row with the latest last_seen."""
    u = vectors.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)))
    w = F.struct("last_seen", "__src")
    cols = [c for c in vectors.columns if c not in ("tenant", "template_id")]
    return u.groupBy("tenant", "template_id").agg(*[F.max_by(c, w).alias(c) for c in cols])


def upsert_vector_table(path: str, new: DataFrame, writer: str | None = None, batch: int | None = None) -> DataFrame | None:
    """U4 sink: replace vectors by (tenant, template_id) in a committed table; only touched buckets are rewritten."""
    table = Table(new.sparkSession, path, ["tenant", "template_id"])
    table.merge(new, lambda old, rows: upsert_vectors(old if old is not None else rows.limit(0), rows), writer, batch)
    return table.read()


def point_id(template_id: Column) -> Column:
    """Optional numeric point id: 31-polynomial hash of the id's UTF-8 bytes
    mod 2^64, as a decimal (exact, no overflow under ANSI mode)."""
    hexs = F.regexp_extract_all(F.hex(template_id.cast("binary")), F.lit("(..)"), 1)
    mod = F.lit("18446744073709551616").cast("decimal(38,0)")
    return F.aggregate(hexs, F.lit(0).cast("decimal(38,0)"),
                       lambda acc, h: F.pmod(acc * 31 + F.conv(h, 16, 10).cast("decimal(38,0)"), mod)
                       .cast("decimal(38,0)")).cast("decimal(20,0)")


# ---------------------------------------------------------------- kNN core
def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id; ties at the edge are compared, not cut."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors as doubles): the rows of a list column that hold ``width`` finite numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == width)
    flat = vectors.take(pa.array(rows)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    fine = np.isfinite(v).all(axis=1)
    return rows[fine], v[fine]


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


@dataclass
class Block:
    """Queries that are sent to all tasks together: unit vectors, filters, time spans and the lists they ask for."""
    ids: list[str]
    vectors: np.ndarray
    filters: list[dict[str, list[str]]]
    spans: np.ndarray | None = None  # (start, end) in microseconds
    lists: list[np.ndarray] | None = None
    groups: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        """Queries of equal filters (and lists) are scored together: list (None: any) -> [(filters, members)]."""
        by: dict = {}
        for i, f in enumerate(self.filters):
            own = tuple(sorted((c, tuple(sorted(v))) for c, v in f.items()))
            for at in [None] if self.lists is None else self.lists[i].tolist():
                by.setdefault(at, {}).setdefault(own, []).append(i)
        self.groups = {at: [(f, np.array(m)) for f, m in g.items()] for at, g in by.items()}


def score_batches(sent, k: int, id_col: str, vec_col: str, list_col: str | None = None,
                  span_cols: tuple[str, str] = ()) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow body: running top-k per query over one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value if hasattr(sent, "value") else sent
        top = [(np.empty(0), np.empty(0, dtype=object)) for _ in block.ids]

        def take(rows: np.ndarray, v: np.ndarray, ids: np.ndarray, spans: np.ndarray | None, members: np.ndarray) -> None:
            step = max(1, CELLS // len(rows))
            for some in np.split(members, range(step, len(members), step)):
                # Rounded so that equal vectors score equally whatever their place in a batch.
                scores = np.round(block.vectors[some] @ v.T, 12)
                if block.spans is not None:
                    asked = block.spans[some]
                    scores[(spans[0] > asked[:, 1:]) | (spans[1] < asked[:, :1])] = -np.inf
                for row, qi in zip(scores, some.tolist(), strict=True):
                    at = _best(row, ids, k)
                    at = at[row[at] > -np.inf]
                    s, i = np.concatenate([top[qi][0], row[at]]), np.concatenate([top[qi][1], ids[at]])
                    at = _best(s, i, k)
                    top[qi] = s[at], i[at]

        for b in batches:
            rows, v = matrix(b[vec_col], block.vectors.shape[1])
            if not len(rows) or not block.ids:
                continue
            v = unit(v)
            ids = b[id_col].cast(pa.string()).to_numpy(zero_copy_only=False)[rows]
            spans = np.stack([b[c].cast(pa.int64()).to_numpy(zero_copy_only=False)[rows] for c in span_cols]) if block.spans is not None else None
            parts = [(None, np.arange(len(rows)))]
            if list_col:
                own = b[list_col].to_numpy(zero_copy_only=False)[rows]
                order = np.argsort(own, kind="stable")
                cuts = np.flatnonzero(np.diff(own[order])) + 1
                parts = [(int(own[p[0]]), p) for p in np.split(order, cuts)]
            for at, part in parts:
                for filters, members in block.groups.get(at, []):
                    mask = np.ones(len(part), dtype=bool)
                    for c, allowed in filters:
                        mask &= pc.is_in(b[c], value_set=pa.array(allowed, pa.string())).to_numpy(zero_copy_only=False)[rows[part]]
                    own = part[mask]
                    if len(own):
                        take(own, v[own], ids[own], spans[:, own] if spans is not None else None, members)
        n = [len(s) for s, _ in top]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(block.ids, dtype=object), n), pa.string()), pa.array(np.concatenate([i for _, i in top]), pa.string()),
                                              pa.array(np.concatenate([s for s, _ in top]))], ["query_id", "id", "score"])
    return run


def dealt(queries: DataFrame) -> tuple[int, list[Column]]:
    """(width, a condition per block): blocks of about ``BLOCK_BYTES`` by a hash of the query's id."""
    total, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    parts = max(1, -(-total * 8 * max(1, width or 0) // BLOCK_BYTES))
    return max(0, width or 0), [F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n for n in range(parts)]


def block_of(queries: DataFrame, width: int, filter_cols: tuple) -> Block:
    """The queries (query_id, v, f, start, end) as one block; a query without a vector of this width asks for nothing."""
    t = queries.orderBy("query_id").toArrow().combine_chunks()
    rows, v = matrix(t["v"], width)
    t = t.take(pa.array(rows))
    # Blank values ask for nothing.
    asked = [{c: [x for x in vs if x and x.strip()] for c, vs in (f or []) if c in filter_cols} for f in t["f"].to_pylist()]
    ends = [t[c].cast(pa.float64()).fill_null(far).to_numpy() for c, far in (("start", -np.inf), ("end", np.inf))]
    spans = np.stack(ends, axis=1)
    return Block(t["query_id"].to_pylist(), unit(v), [{c: vs for c, vs in f.items() if vs} for f in asked], spans if np.isfinite(spans).any() else None)


def _micros(c: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def asked_queries(queries: DataFrame, query_vec: str = "qvec", query_filters: str | None = None) -> DataFrame:
    """The table that blocks are read from: (query_id, v, f, start, end)."""
    from ..session import cut_lineage
    f = F.col(query_filters) if query_filters else F.lit(None).cast("map<string,array<string>>")
    times = [(_micros(f"`{c}`") if c in queries.columns else F.lit(None).cast("long")).alias(c) for c in ("start", "end")]
    return cut_lineage(queries.select(F.col("query_id").cast("string").alias("query_id"), F.col(query_vec).alias("v"), f.alias("f"), *times), "queries")


def vector_side(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, filter_cols: tuple, more: tuple = ()) -> tuple[DataFrame, tuple]:
    """The columns that scoring reads, and the time span's names if queries have one."""
    spans = ("first_seen", "last_seen") if "start" in queries.columns or "end" in queries.columns else ()
    v = vectors.where(F.col(id_col).isNotNull())
    return v.select(id_col, vec_col, *filter_cols, *more, *[_micros(c).alias(c) for c in spans]), spans


def to_all(spark, value):
    """Broadcast a block, or, in a session without a SparkContext (Spark Connect), ship it with the task."""
    try:
        return spark.sparkContext.broadcast(value)
    except (AttributeError, NotImplementedError):
        return value


def knn(queries: DataFrame, vectors: DataFrame, k: int, id_col: str, vec_col: str = "embedding",
        query_vec: str = "qvec", filter_cols: tuple = (), query_filters: str | None = None) -> DataFrame:
    """Exact cosine top-k per query -> (query_id, id, score, rank); equal scores by id.

    ``queries``: (query_id, qvec[, filter map col][, start, end]). They are dealt into blocks
    of at most ``BLOCK_BYTES``, and each block is one scan of the vectors, so any number of
    queries is answered. ``filter_cols``: vector columns that query filters may constrain; a query
    filter is a map column -> allowed values (array). A query with start or end meets vectors
    whose (first_seen, last_seen) overlaps them. Vectors without an id, and null or
    unfinished ones, are no hits."""
    q = asked_queries(queries, query_vec, query_filters)
    side, spans = vector_side(vectors, queries, id_col, vec_col, tuple(filter_cols))
    out, (width, blocks) = None, dealt(q)
    for own in blocks:
        block = block_of(q.where(own), width, tuple(filter_cols))
        part = side.mapInArrow(score_batches(to_all(vectors.sparkSession, block), k, id_col, vec_col, span_cols=spans), HIT_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return ranked(out, k)


def ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def searchable(vectors: DataFrame, allow: list[str] | None = None) -> DataFrame:
    """(id, embedding, tenant, first_seen, last_seen, labels as columns): what ``search`` scores and filters."""
    cols = [F.col("labels")[a].alias(a) for a in allow or P.SEARCH_FILTER_LABELS]
    return vectors.select(F.concat_ws("\u0001", "tenant", "template_id").alias("id"), "embedding", "tenant", "first_seen", "last_seen", *cols)


def search(queries: DataFrame, vectors: DataFrame, k: int = P.TOP_K_DEFAULT,
           allow: list[str] | None = None, dim: int = P.VECTOR_DIM, index=None, probes: int | None = None) -> DataFrame:
    """E9 + E10 + E12 + E14: queries (query_id, query, tenant?, label_filter map<string,
    string|array>, start?, end?) against template vectors. Blank queries give no hits; tenant
    (when given), allow-listed non-blank label filters (any of an array's values) and the
    overlap of [first_seen, last_seen] with [start, end] are applied before scoring;
    other filter keys are ignored. With ``index``, a ``VectorIndex`` of ``searchable(vectors)``,
    each query meets the vectors of its ``probes`` nearest lists."""
    allow = allow or P.SEARCH_FILTER_LABELS
    q = queries.filter(F.length(F.trim(F.col("query"))) > 0)
    q = q.withColumn("qvec", embed(F.col("query"), dim))
    has_tenant = "tenant" in q.columns
    has_filter = "label_filter" in q.columns
    parts = []
    if has_tenant:
        parts.append(F.when(F.col("tenant").isNotNull(), F.create_map(F.lit("tenant"), F.array(F.col("tenant")))))
    if has_filter:
        lf = F.col("label_filter")
        vt = q.schema["label_filter"].dataType.valueType.simpleString()
        as_arr = (lambda v: v) if vt.startswith("array") else (lambda v: F.array(v))
        m = F.map_filter(lf, lambda kk, v: F.array_contains(F.array(*[F.lit(a) for a in allow]), kk))
        parts.append(F.transform_values(m, lambda kk, v: as_arr(v)))
    if parts:
        parts = [F.coalesce(p, F.create_map().cast("map<string,array<string>>")) for p in parts]
        q = q.withColumn("__f", F.map_concat(*parts) if len(parts) > 1 else parts[0])
    by = ("tenant", *allow)
    if index is not None:
        hits = index.search(q, effective_k(k), probes, filter_cols=by, query_filters="__f" if parts else None)
    else:
        hits = knn(q, searchable(vectors, allow), effective_k(k), "id", filter_cols=by, query_filters="__f" if parts else None)
    return hits.withColumn("tenant", F.split("id", "\u0001")[0]) \
        .withColumn("template_id", F.split("id", "\u0001")[1]).drop("id")


def attach_catalog(hits: DataFrame, catalog: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """J3 + J4: hits inner-join the catalog on (tenant, template_id) (missing ids
    drop out), then count_24h from the stats table (absent or negative -> 0)."""
    cat = catalog.select("tenant", "template_id", "template_text", "regex", "labels", "first_seen", "last_seen")
    out = hits.join(cat, ["tenant", "template_id"])
    if stats is not None:
        s = stats.filter(F.col("window") == "24h").select("tenant", "template_id", F.col("count").alias("__c"))
        out = out.join(s, ["tenant", "template_id"], "left")
        out = out.withColumn("count_24h", F.greatest(F.coalesce("__c", F.lit(0)), F.lit(0))).drop("__c")
    return out


def rerank_recent(hits: DataFrame, end, boost: float = P.RECENCY_BOOST) -> DataFrame:
    """Order by score + boost / (1 + |hours(end - last_seen)|), stable on
    the original rank; the returned score is unchanged."""
    e = F.lit(end) if not isinstance(end, Column) else end
    hours = F.abs(F.expr("timestampdiff(MICROSECOND, last_seen, __end)") / 3.6e9)
    key = F.col("score") + F.when(F.col("last_seen").isNotNull(), F.lit(boost) / (1 + hours)).otherwise(0.0)
    h = hits.withColumn("__end", e.cast("timestamp_ntz")).withColumn("boosted", key).drop("__end")
    w = Window.partitionBy("query_id").orderBy(F.col("boosted").desc(), F.col("rank"))
    return h.withColumn("rerank", F.row_number().over(w))


def explain_hits(hits: DataFrame, query_col: str = "query", text_col: str = "template_text") -> DataFrame:
    """Tokens shared by query and template."""
    return hits.withColumn("matched_tokens", F.array_sort(shared_tokens(F.col(query_col), F.col(text_col))))


def filter_catalog(catalog: DataFrame, filters: dict | None = None, start=None, end=None) -> DataFrame:
    """Any-of label filters and time-range overlap on the catalog."""
    c = catalog
    for key, vals in (filters or {}).items():
        vals = vals if isinstance(vals, (list, tuple)) else [vals]
        c = c.filter(F.col("labels")[key].isin(*vals))
    if start is not None:
        c = c.filter(F.col("last_seen") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        c = c.filter(F.col("first_seen") <= F.lit(end).cast("timestamp_ntz"))
    return c
