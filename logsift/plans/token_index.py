"""An index of the tokens of stored lines, for plan execution.

Lines are stored sorted by (date, labels, time) in a Parquet table partitioned by
date, each with the number of its block (``BLOCK_ROWS`` lines in order) and its row
there. Beside it stand the postings, partitioned by date and sorted by token: for every block, set of labels
and token the rows that hold the token. A token that is in more than
``RARE`` of a block's lines has no list of rows there; all lines of the block with these labels are
its candidates. Tokens are stored as 64-bit hashes: a collision adds candidates, and
the regex decides.

A plan's anchor (``logql.plan_anchor``) is a whole token of every line the plan matches, so the
postings of the anchor name all of them. Postings are pruned by date as partitions, by token through the
sorted files, and joined on the token; labels and dates that do not fit go before any line is
read. Lines meet their candidates by an equi-join on (date, block, row), and the regex runs on these
only. Plans without an anchor meet the lines of the time range (``logql.execute_loose``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..session import cut_lineage, forget
from . import logql as L

BLOCK_BITS = 13
BLOCK_ROWS = 1 << BLOCK_BITS
RARE = 1 / 16


def _postings(group: list[str], rare: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow body over lines (group, row, words) that come group by group: the rows of each of a group's
    tokens, or null where it is in too many of them. A group is part of a block, so it is bounded."""

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        lines = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        n, words = lines["words"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lines["words"].flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(lines["row"].to_numpy(), n)
        order = np.lexsort((rows, words))
        words, rows = words[order], rows[order]
        new = np.flatnonzero(np.diff(words, prepend=words[:1]) | np.diff(rows, prepend=rows[:1]))
        kept = np.union1d(new, [0])[:len(words)].astype(np.int64) if len(words) else new  # equal hashes in a line are one
        words, rows = words[kept], rows[kept]
        tokens, at, n = np.unique(words, return_index=True, return_counts=True)
        few = n <= max(1, int(np.floor(rare * len(lines))))
        held = rows[np.repeat(few, n)].astype(np.int32)
        edges = np.append(0, np.cumsum(np.where(few, n, 0))).astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(edges), pa.array(held), mask=pa.array(~few))
        same = pa.array(np.zeros(len(tokens), np.int64))
        return pa.RecordBatch.from_arrays([*[lines[c].take(same) for c in group], pa.array(tokens, pa.int64()), out], [*group, "token", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch[c].to_pylist() for c in group), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo < hi:
                    if parts and keys[lo] != own:
                        yield made(parts)
                        parts = []
                    own = keys[lo]
                    parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield made(parts)
    return run


class TokenIndex:
    """Stored lines and postings in a folder that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys or P.SELECTOR_LABELS
        self.lines = spark.read.parquet(f"{self.path}/lines")
        self.postings = spark.read.parquet(f"{self.path}/postings")

    @classmethod
    def build(cls, logs: DataFrame, path: str, keys: list[str] | None = None, rare: float = RARE) -> TokenIndex:
        """Store (log_id, ts, message, labels) and index every token. A line without a time is
        stored under the null date and found by searches without a time range."""
        keys, path = keys or P.SELECTOR_LABELS, path.rstrip("/")
        own = [f"__l_{k}" for k in keys]
        lines = L.lines_of(logs, keys).withColumn("date", F.to_date("ts"))
        lines = lines.repartitionByRange("date", *own, "ts", "log_id").sortWithinPartitions("date", *own, "ts", "log_id")
        # The place in the sorted task; the task's number is in its upper bits.
        at = F.monotonically_increasing_id()
        lines = lines.withColumn("at", at).withColumn("block", F.shiftright("at", BLOCK_BITS)).withColumn("row", F.col("at").bitwiseAND(BLOCK_ROWS - 1).cast("int"))
        lines.drop("at").write.mode("overwrite").partitionBy("date").parquet(f"{path}/lines")
        stored = logs.sparkSession.read.parquet(f"{path}/lines")
        # A block's lines meet in one task, as their hashes only; postings are made there, a group of equal date and labels at a time.
        words = F.transform(F.filter(L.tokens(F.col("message")), lambda t: t != ""), lambda t: F.xxhash64(t))
        group = ["date", "block", *own]
        rows = stored.select(*group, "row", words.alias("words")).repartition("block").sortWithinPartitions(*group, "row")
        kinds = T.StructType([*rows.schema.fields[:-2], T.StructField("token", T.LongType()), T.StructField("rows", T.ArrayType(T.IntegerType()))])
        found = cut_lineage(rows.mapInArrow(_postings(group, rare), kinds), "postings")
        found.repartitionByRange("date", "token", "block").sortWithinPartitions("date", "token", "block").write.mode("overwrite").partitionBy("date").parquet(f"{path}/postings")
        forget(found)
        return cls(logs.sparkSession, path, keys)

    def _days(self, start, end) -> Column:
        days = F.lit(True)
        if start is not None:
            days = days & (F.col("date") >= F.to_date(F.lit(start).cast("timestamp_ntz")))
        if end is not None:
            days = days & (F.col("date") <= F.to_date(F.lit(end).cast("timestamp_ntz")))
        return days

    def candidates(self, plans: DataFrame, start=None, end=None) -> DataFrame:
        """(plan columns, date, block, row): where lines with a plan's anchor and labels stand; a null row means
        all lines of the block with the plan's labels."""
        anchored = plans.filter(F.col("__anchor").isNotNull()).withColumn("token", F.xxhash64("__anchor")).drop("__anchor")
        hits = self.postings.where(self._days(start, end)).join(anchored, "token").filter(L.labels_fit(self.keys))
        return hits.select(*[c for c in anchored.columns if c != "token"], "date", "block", F.explode_outer("rows").alias("row"))

    def execute(self, plans: DataFrame, start=None, end=None) -> DataFrame:
        """The lines that satisfy the plans, like ``logql.execute_plan`` on the stored lines."""
        plans = L.prepared_plans(plans, self.keys)
        lines = self.lines.where(self._days(start, end))
        for edge, test in ((start, lambda t: F.col("ts") >= t), (end, lambda t: F.col("ts") <= t)):
            if edge is not None:
                lines = lines.where(test(F.lit(edge).cast("timestamp_ntz")))
        found = self.candidates(plans, start, end).withColumnsRenamed({"date": "c_date", "block": "c_block", "row": "c_row"})
        place = F.col("date").eqNullSafe(F.col("c_date")) & (F.col("block") == F.col("c_block"))
        fits = L.labels_fit(self.keys) & L.message_fits(F.col("message"), F.col("__literal"), F.col("regex"))
        cols = ["plan_id", "log_id", "ts", "message", *[F.col(f"__l_{k}").alias(k) for k in self.keys]]
        rare = lines.join(found.where("c_row IS NOT NULL"), place & (F.col("row") == F.col("c_row")))
        often = lines.join(found.where("c_row IS NULL").drop("c_row").distinct(), place)
        # A token can be rare with one set of labels of a block and not with another, so a line may be named twice.
        at = ["date", "block", "row"]
        out = rare.filter(fits).select(*cols, *at).unionByName(often.filter(fits).select(*cols, *at))
        out = out.dropDuplicates(["plan_id", *at]).drop(*at)
        return out.unionByName(L.execute_loose(lines, plans.filter(F.col("__anchor").isNull()), self.keys))

    def drop_before(self, date: str) -> None:
        """K7: remove the days before ``date`` from lines and postings, whole partitions at a time."""
        from ..sinks.commits import Files
        files = Files(self.spark, self.path)
        for part in ("lines", "postings"):
            for s in files.names(f"{self.path}/{part}"):
                name = s.getPath().getName()
                if name.startswith("date=") and name[5:] < date and name[5:6].isdigit():
                    files.delete(f"{self.path}/{part}/{name}")
        self.lines = self.spark.read.parquet(f"{self.path}/lines")
        self.postings = self.spark.read.parquet(f"{self.path}/postings")
