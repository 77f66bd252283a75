"""Exact top-k search by inner product over a pivot-distance index.

Largest inner product is made nearest neighbour: with M the largest norm, a
stored vector v gets one more component sqrt(M^2 - |v|^2) and a query one of 0;
then distance^2 = |q|^2 + M^2 - 2 q.v, so smaller distance is larger score.

Index: ``PIVOTS`` vectors, those with the smallest hash of the id, are pivots, in an order of neighbours. Every
vector is keyed by its nearest pivot and its distance from it, and the table is
range-partitioned on that key into shards of at most ``SHARD_BYTES`` of
vectors, so a pivot with any share of all rows just has more shards. The vectors of one
pivot in one shard are an annulus, known by its least and largest distance.

Search: by the triangle inequality no vector of an annulus [lo, hi] around p is
nearer to q than max(lo - d(q, p), d(q, p) - hi). Queries are sent to shards, never
vectors to queries. First each goes to its ``SEEDS`` annuli of the lowest bound, which
gives it k scores; then to all other shards that have an annulus whose bound is not
beyond the distance of the k-th score. A task holds one shard's vectors and
streams its queries; within the shard, rings of at most ``RING`` vectors are visited for the
queries whose bound still reaches them, and the k-th score tightens on the way. Bounds
have a margin for rounding, so nothing is missed; where bounds exclude nothing, as for
scattered vectors of many dimensions, all shards are searched.

Scores are exact integers: in float arithmetic while all sums stay below 2^53, else
candidates are picked with a margin and scored as Python integers; scores beyond 64
bits are held at the ends of the range.

Defined results: a vector that is null or holds a null or non-finite component
takes no part; an empty vector scores 0 with all; a shorter vector counts as padded with
zeros; repeated rows are separate rows, and a query meets all rows but itself; a null id is no
query, and comes last among ties; of equal scores with equal ids any order is one
of equal rows; a table of fewer than k + 1 rows gives all; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import cut_lineage

TOP_K, EVERY, SCALE = 10, 100, 1024.0
PIVOTS, SEEDS, RING = 128, 4, 1024
SHARD_BYTES = 32 << 20  # of a shard's vectors as doubles
SMALL_ROWS = 1024  # a table is spread over the cores as long as shards have so many rows
CELLS = 2 << 20  # scores computed at a time
HITS = "row long, vec_id long, hit_row long, score long"


def integer_vectors(df: DataFrame, vec_id: str, embedding: str, scale: float = SCALE) -> DataFrame:
    """(row, vec_id, vec): whole-number vectors of all rows that take part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    vec = F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return df.where(F.col(embedding).isNotNull() & fine).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"))


def _matrix(vecs: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    first = vecs.offsets.to_numpy().astype(np.int64)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size, out = np.diff(first), np.zeros((len(vecs), width), dtype=np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(len(vecs), width)
    row = np.repeat(np.arange(len(vecs)), size)
    out[row, np.arange(len(flat)) - (first[:-1] - first[0])[row]] = flat
    return out


def _distances(vectors: np.ndarray, pivots: np.ndarray, norm2: float, stored: bool) -> np.ndarray:
    """Distances of stored vectors (with their further component) or of queries (with 0) from the pivots."""
    v, p = vectors.astype(np.float64), pivots.astype(np.float64)
    own = (v * v).sum(axis=1)
    tail = np.sqrt(np.maximum(norm2 - (p * p).sum(axis=1), 0))
    d2 = -2 * (v @ p.T) + norm2
    if stored:
        d2 += norm2 - 2 * np.sqrt(np.maximum(norm2 - own, 0))[:, None] * tail
    else:
        d2 += own[:, None]
    return np.sqrt(np.maximum(d2, 0))


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is the nearest to the one before, so that shards hold neighbouring pivots."""
    v, order, left = pivots.astype(np.float64), [0][:len(pivots)], list(range(1, len(pivots)))
    while left:
        order.append(left.pop(int(((v[left] - v[order[-1]]) ** 2).sum(axis=1).argmin())))
    return pivots[order]


class Index:
    """The written table of keyed vectors, and what searching it needs."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS):
        """``vectors`` (row, vec_id, vec) is a written table."""
        spark = vectors.sparkSession
        norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, width, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm2)).first()
        self.width, self.norm2 = max(1, width or 0), most or 0.0
        chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).select("vec").toArrow()
        self.pivots = _chained(_matrix(chosen["vec"], self.width))
        self.margin = 1e-6 * max(1.0, self.norm2) ** 0.5
        rows = max(1, SHARD_BYTES // (8 * self.width))
        self.shards = max(1, -(-n // rows), min(4 * spark.sparkContext.defaultParallelism, -(-n // SMALL_ROWS)))
        width_, pivots_, norm2_ = self.width, self.pivots, self.norm2

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b["vec"], width_), pivots_, norm2_, True)
                    at = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])],
                                                     [*b.schema.names, "pivot", "dist"])

        table = vectors.mapInArrow(keyed, "row long, vec_id long, vec array<long>, pivot int, dist double")
        table = table.repartitionByRange(self.shards, "pivot", "dist", "row").withColumn("shard", F.spark_partition_id())
        self.table = cut_lineage(table, "pivot_index")
        self.annuli = cut_lineage(self.table.groupBy("shard", "pivot").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")), "annuli")

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(row, shard, bound): for every query and annulus, the least distance a vector there can have."""
        width, pivots, norm2 = self.width, self.pivots, self.norm2

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d = _distances(_matrix(b["vec"], width), pivots, norm2, False)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b["row"].to_numpy(), len(pivots))), pa.array(np.tile(np.arange(len(pivots), dtype=np.int32), len(d))),
                                                      pa.array(d.ravel())], ["row", "pivot", "d"])

        far = queries.select("row", "vec").mapInArrow(measure, "row long, pivot int, d double").join(self.annuli, "pivot")
        return far.select("row", "shard", F.greatest(F.lit(0.0), F.expr("lo - d"), F.expr("d - hi")).alias("bound"))


def _search(width: int, pivots: np.ndarray, norm2: float, margin: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a stream that brings, shard by shard, first vectors by (pivot, dist) and then queries."""

    def rings(pivot: np.ndarray, dist: np.ndarray) -> list[tuple[int, int, int, float, float]]:
        cuts = np.flatnonzero(np.diff(pivot)) + 1
        out = []
        for a, z in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
            out += [(i, min(i + RING, z), pivot[i], dist[i], dist[min(i + RING, z) - 1]) for i in range(a, z, RING)]
        return out

    def best(shard: tuple, q: np.ndarray, row: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) places of the k best of each query of a block."""
        v, v_float, v_row, _, v_order, parts = shard
        q_float = q.astype(np.float64)
        most = float(np.abs(q_float).max(initial=0)) * float(np.abs(v_float).max(initial=0)) * width
        slack = 0.0 if most < 2**53 else most * 2.0**-48
        d, own = _distances(q, pivots, norm2, False), (q_float * q_float).sum(axis=1)
        kth, top = floor - slack, np.full((len(q), k), -np.inf)
        found = []
        for a, z, pivot, lo, hi in parts:
            bound = np.maximum(lo - d[:, pivot], d[:, pivot] - hi)
            at = np.flatnonzero(bound - margin <= np.sqrt(np.maximum(own + norm2 - 2 * kth, 0)))
            if not len(at):
                continue
            score = q_float[at] @ v_float[a:z].T
            score[row[at][:, None] == v_row[a:z]] = -np.inf
            top[at] = np.partition(np.concatenate([top[at], score], axis=1), -k, axis=1)[:, -k:]
            kth[at] = np.maximum(kth[at], top[at].min(axis=1) - slack)
            i, j = np.nonzero((score >= kth[at][:, None]) & (score > -np.inf))
            found.append((at[i], j + a, score[i, j]))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 3
        i, j, s = map(np.concatenate, zip(*found, strict=True))
        keep = s >= kth[i]
        i, j, s = i[keep], j[keep], s[keep]
        if slack:
            s = np.array([min(max(sum(int(x) * int(y) for x, y in zip(q[a], v[b], strict=True)), -2**63), 2**63 - 1) for a, b in zip(i, j, strict=True)], dtype=np.int64)
        s = s.astype(np.int64)
        order = np.lexsort((v_row[j], v_order[j], ~s, i))
        i, j, s = i[order], j[order], s[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[keep], j[keep], s[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pending, at = None, [], None
        for b in batches:
            shards, kinds = b["shard"].to_numpy(), b["kind"].to_numpy()
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if shards[lo] != at:
                    shard, pending, at = None, [], shards[lo]
                if kinds[lo] == 0:
                    pending.append(part)
                    continue
                if not pending:
                    continue
                if shard is None:
                    t = pa.Table.from_batches(pending).combine_chunks()
                    v = _matrix(t["vec"], width)
                    shard = (v, v.astype(np.float64), t["row"].to_numpy(), t["vec_id"].combine_chunks(), t["vec_id"].fill_null(2**63 - 1).to_numpy(),
                             rings(t["pivot"].to_numpy(), t["dist"].to_numpy()))
                step = max(1, CELLS // max(RING, len(shard[2])))
                for a in range(0, part.num_rows, step):
                    own = part.slice(a, step)
                    row, floor = own["row"].to_numpy(), own["dist"].fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    i, j, s = best(shard, _matrix(own["vec"], width), row, floor.astype(np.float64))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(row[i]), shard[3].take(pa.array(j)), pa.array(shard[2][j]), pa.array(s)],
                                                         ["row", "vec_id", "hit_row", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = TOP_K, vec_id: str = "vec_id", embedding: str = "embedding",
          scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that fits ``queries``, a condition
    on column vec_id, the k other rows of the largest inner product."""
    table = cut_lineage(integer_vectors(vectors, vec_id, embedding, scale), "integer_vectors")
    index = Index(table)
    asked = cut_lineage(index.table.where(queries).select("row", "vec_id", "vec"), "queries")
    bounds = index.bounds(asked)
    stored = index.table.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "vec", "pivot", "dist")

    def visit(probes: DataFrame) -> DataFrame:
        """``probes``: (row, shard, floor), each pair once; floor is a score below which nothing is wanted."""
        sent = probes.join(asked, "row").select("shard", F.lit(1).alias("kind"), "row", "vec_id", "vec", F.lit(0).alias("pivot"), F.col("floor").cast("double").alias("dist"))
        both = stored.unionByName(sent).repartitionById(index.shards, "shard").sortWithinPartitions("shard", "kind", "pivot", "dist")
        return cut_lineage(both.mapInArrow(_search(index.width, index.pivots, index.norm2, index.margin, k), HITS), "hits")

    nearest = F.row_number().over(Window.partitionBy("row").orderBy("bound", "shard"))
    first = bounds.withColumn("n", nearest).where(F.col("n") <= SEEDS).select("row", "shard").distinct()
    first = cut_lineage(first, "first_probes")
    hits = visit(first.withColumn("floor", F.lit(None).cast("double")))
    best = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "hit_row"))
    # The k-th score so far; scores at the end of the range bound nothing.
    floors = hits.withColumn("n", best).where(F.col("n") == k).where(F.abs(F.col("score").cast("double")) < 2.0**62).select("row", F.col("score").alias("floor"))
    own2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    reach = asked.select("row", own2.alias("own2")).join(floors, "row", "left")
    reach = reach.select("row", "floor", F.sqrt(F.greatest(F.lit(0.0), F.col("own2") + F.lit(index.norm2) - 2 * F.col("floor").cast("double"))).alias("reach"))
    rest = bounds.join(reach, "row").where(F.col("reach").isNull() | (F.col("bound") - F.lit(index.margin) <= F.col("reach")))
    rest = rest.groupBy("row", "shard").agg(F.first("floor").alias("floor")).join(first, ["row", "shard"], "left_anti")
    hits = hits.unionByName(visit(rest))
    out = hits.withColumn("rank", best).where(F.col("rank") <= k)
    return out.join(asked.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", "vec_id", "score")


def op12(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings, F.col("vec_id") % EVERY == 0)
