"""Skew-safe running sums in (ts, log_id) order within a group.

``row_number()`` / running ``sum`` over a window partitioned by a coarse group
(a stream-minute, a tenant-minute) sorts the whole group in one task. Here the
group is split by second: rows are rolled up per (group, second) with partial
aggregation, prefix sums run over that small rollup, and the rollup is joined
back; only one (group, second) is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of equal names in which null equals null, so that
    rows with a null key are kept."""
    right = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(F.col(f"__r_{c}"))
    return left.join(right, cond, how).drop(*[f"__r_{c}" for c in on])


def running_sum(df: DataFrame, group: list[str], value: str | None, out: str,
                inclusive: bool = True) -> DataFrame:
    """Adds ``out`` = sum of ``value`` (1 per row when None) over the rows of the
    same ``group`` ordered by (ts, log_id), up to and including the row
    (``inclusive=False``: strictly before it)."""
    v = F.col(value) if value else F.lit(1)
    d = df.withColumn("__sec", F.date_trunc("second", F.col("ts"))).withColumn("__v", v.cast("bigint"))
    from .templates import materialize
    d = materialize(d.repartition(*group, "__sec"))  # read by the rollup and the join-back
    roll = d.groupBy(*group, "__sec").agg(F.sum("__v").alias("__sv"))
    w = Window.partitionBy(*group).orderBy("__sec").rowsBetween(Window.unboundedPreceding, -1)
    roll = roll.withColumn("__before", F.coalesce(F.sum("__sv").over(w), F.lit(0))).drop("__sv")
    j = null_safe_join(d, roll, [*group, "__sec"])
    ws = Window.partitionBy(*group, "__sec").orderBy("ts", "log_id")
    frame = ws.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = F.coalesce(F.sum("__v").over(frame), F.lit(0))
    return j.withColumn(out, F.col("__before") + within).drop("__sec", "__v", "__before")
