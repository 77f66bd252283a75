"""Inverted lists over vectors: a candidate index for kNN (E9) with exact scores.

Centroids come from spherical k-means on at most ``SAMPLE`` vectors, those with the
smallest hash of the id; every vector is then assigned to the list of its nearest centroid.
The index is a Parquet table partitioned by list, with the columns that
searches filter on, and the centroids beside it. A list of any share of the vectors is written by several
tasks (``FILE_ROWS`` a file), so near-equal vectors in one list are no hot task.

A query meets the vectors of its ``probes`` nearest lists and no others: lists that no
query of a block asks for are pruned as partitions, and inside a list only the
queries that ask for it are scored. Scores are the exact cosines, so only candidates can be
missed, never misplaced; with all lists probed the result is that of ``search.knn``, which
stays the exact way. Blocks of queries are broadcast in bounded bytes, those near to
each other together, so a block reads few lists.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search as S

SAMPLE = 20_000  # vectors that centroids are fitted on
MAX_LISTS, ROUNDS = 4096, 8
FILE_ROWS = 100_000


def centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids of unit vectors; the first are vectors spread over
    the sample, and a centroid without members moves to the vector that fits its own worst."""
    start = sample[np.unique(np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int))]
    c = np.unique(start, axis=0)
    for _ in range(rounds):
        score = sample @ c.T
        at = score.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        size = np.bincount(at, minlength=len(c))
        worst = np.argsort(score[np.arange(len(at)), at], kind="stable")
        empty = np.flatnonzero(size == 0)
        sums[empty] = sample[worst[:len(empty)]]
        c = S.unit(sums)
    return c


class VectorIndex:
    """An index that ``build`` has written to a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        t = spark.read.parquet(f"{self.path}/centroids").orderBy("list").toArrow()
        self.vectors = spark.read.schema(T.StructType.fromJson(json.loads(t["kind"][0].as_py()))).parquet(f"{self.path}/vectors")
        self.centroids = np.array(t["centroid"].to_pylist(), dtype=np.float64).reshape(t.num_rows, -1)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", lists: int | None = None,
              sample: int = SAMPLE) -> VectorIndex:
        """Index all vectors that have an id and finite numbers of the usual length; ``lists``:
        by default the square root of their number, ``MAX_LISTS`` at most."""
        spark = vectors.sparkSession
        sizes = vectors.groupBy(F.size(vec_col).alias("w")).agg(F.count(F.lit(1)).alias("n")).where("w > 0").orderBy(F.col("n").desc(), "w").first()
        width, n = (sizes["w"], sizes["n"]) if sizes else (1, 0)
        fine = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == width))
        some = fine.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vec_col).alias("v")).toArrow()
        v = S.unit(S.matrix(some["v"], width)[1]) if some.num_rows else np.ones((1, width))
        v = v if len(v) else np.ones((1, width))
        c = centroids(v, min(lists or max(1, round(n ** 0.5)), MAX_LISTS))
        kinds = T.StructType([*fine.schema.fields, T.StructField("list", T.IntegerType())])
        own = spark.createDataFrame(pa.table({"list": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64())),
                                              "kind": pa.array([kinds.json()] * len(c))}))
        own.write.mode("overwrite").parquet(f"{path.rstrip('/')}/centroids")
        assigned = fine.mapInArrow(_assign(c, vec_col, width), kinds)
        # A list is spread over as many tasks as it has files; the sizes are at most MAX_LISTS rows.
        counts = {r["list"]: -(-r["n"] // FILE_ROWS) for r in assigned.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
        files = F.element_at(F.create_map(*[F.lit(x) for p in counts.items() for x in p]), F.col("list")) if counts else F.lit(1)
        assigned.repartition("list", F.pmod(F.xxhash64(id_col), files)).write.mode("overwrite").partitionBy("list").parquet(f"{path.rstrip('/')}/vectors")
        return cls(spark, path)

    def nearest(self, v: np.ndarray, probes: int) -> np.ndarray:
        """Per vector its ``probes`` nearest lists, the nearest first."""
        score = S.unit(v) @ self.centroids.T
        return np.argsort(-score, axis=1, kind="stable")[:, :probes]

    def search(self, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "id", vec_col: str = "embedding", query_vec: str = "qvec",
               filter_cols: tuple = (), query_filters: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) like ``search.knn``, over the ``probes`` nearest lists
        of each query (None: all vectors, which is exact)."""
        probes = None if probes is None else max(1, min(probes, len(self.centroids)))
        q = S.asked_queries(queries, query_vec, query_filters)
        side, spans = S.vector_side(self.vectors, queries, id_col, vec_col, tuple(filter_cols), ("list",))
        width = self.centroids.shape[1]
        home = q.mapInArrow(_homes(self.centroids, width), "query_id string, list int")
        out = None
        for own in self._blocks(home, width):
            block = S.block_of(q.join(home.where(own).select("query_id").distinct(), "query_id", "left_semi"), width, tuple(filter_cols))
            if probes is not None:
                lists = self.nearest(block.vectors, probes) if block.ids else np.empty((0, probes), dtype=np.int64)
                block = S.Block(block.ids, block.vectors, block.filters, block.spans, list(lists))
                asked = side.where(F.col("list").isin(np.unique(lists).tolist()))
                run = S.score_batches(S.to_all(self.spark, block), k, id_col, vec_col, "list", spans)
            else:
                asked, run = side, S.score_batches(S.to_all(self.spark, block), k, id_col, vec_col, None, spans)
            part = asked.mapInArrow(run, S.HIT_SCHEMA)
            out = part if out is None else out.unionByName(part)
        return S.ranked(out, k)

    def _blocks(self, home: DataFrame, width: int) -> Iterator[Column]:
        """Conditions that deal queries into blocks of about ``BLOCK_BYTES``, neighbouring lists together."""
        most = max(1, S.BLOCK_BYTES // (8 * width))
        held, size = [], 0
        for r in home.groupBy("list").agg(F.count(F.lit(1)).alias("n")).orderBy("list").collect():  # at most MAX_LISTS rows
            if size + r["n"] > most and held:
                yield F.col("list").isin(held)
                held, size = [], 0
            if r["n"] > most:
                parts = -(-r["n"] // most)
                yield from ((F.col("list") == r["list"]) & (F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
                            for i in range(parts))
            else:
                held.append(r["list"])
                size += r["n"]
        yield F.col("list").isin(held) if held else F.lit(False)


def _assign(c: np.ndarray, vec_col: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = S.matrix(b[vec_col], width)
            if len(rows):
                own = b.take(pa.array(rows))
                at = (S.unit(v) @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(at)], [*own.schema.names, "list"])
    return run


def _homes(c: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = S.matrix(b["v"], width)
            if len(rows):
                at = (S.unit(v) @ c.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["query_id"].take(pa.array(rows)), pa.array(at)], ["query_id", "list"])
    return run
