"""Connected components on an edge table by alternating star contraction.

Every round replaces edges so that each node points to a smaller neighbour;
rounds go on until the edges no longer change, so there is no round limit.
All steps are keyed joins and partial aggregations; a hub's edges are never
gathered. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, forget


def _large_star(e: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest neighbour or itself."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                .where("u != v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of each node, and itself, to the smallest one."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    ``edges`` has two columns of an orderable type; self-links and repeated
    edges do no harm.
    """
    u, v = edges.columns
    e = cut_lineage(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct(), "edges")
    while True:
        # Done when all edges lead down to centres: no node is on both sides, none has two centres.
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in"), (F.col("v") > F.col("u")).alias("up"))
        ends = ends.union(e.select("v", F.lit(0), F.lit(1), F.lit(False))).groupBy("n").agg(
            F.sum("out").alias("out"), F.max("in").alias("in"), F.max("up").alias("up"))
        if ends.where("up or out > 1 or out + in > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        old, e = e, cut_lineage(_small_star(_large_star(e)), "edges")
        forget(old)
