"""Shards by a k-d tree over document metadata.

The documents are one cell at first. A cell that is to hold several shards is
split at the weighted median (weight: bytes) along its widest metadata
dimension, into two cells of half the shards each, until every cell is one
shard. Dimensions are scaled to 0..1; language and source by a hash of the name,
length by its logarithm. A group of equal texts has one place, the smallest of
its values in each dimension.

Medians are found by counting: one pass sums the bytes of ``BINS`` bins along
the dimension, per cell. Documents of the bin that holds the median are divided
by a second pass over bins of a hash of the text, and, if a group of equal texts
is too large to go to one side, by a third over bins of a hash of the row. So
equal texts stay together unless that would unbalance the cells by more than
``SLACK``, and a group of any size can be split. Each pass aggregates to at
most cells x bins rows, which is all that reaches the driver.

Law ``bytes``: sizes are near equal (up to the length of single documents and
``SLACK`` a level). Slots are gapless ranks: counted per part and shard, shifted
by the counts of the parts before; no shard is gathered.

Defined results: a null text has no bytes (size 1) and the checksum of the empty
text; null language or source is its own value; repeated rows are separate
documents; with fewer documents than shards, some shards stay empty; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import cut_lineage

SHARDS, BINS, SLACK = 16, 4096, 0.001


def _unit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", dims: dict[str, Column] | None = None) -> DataFrame:
    """Sizes, checksums, dimensions and row keys of the documents, as a written table without texts; all in cell 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    dims = dims or {"lang": _unit(F.xxhash64("lang")), "source": _unit(F.xxhash64("source")), "length": F.log2(F.octet_length(t) + 1) / 40}
    d = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"),
                    F.xxhash64(t).alias("text_key"), *[F.coalesce(c, F.lit(0.0)).alias(f"dim_{k}") for k, c in dims.items()],
                    F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(d, "measured")
    # One place per group of equal texts: the smallest value of each dimension.
    names = [f"dim_{k}" for k in dims]
    place = rows.groupBy("text_key").agg(*[F.min(c).alias(c) for c in names])
    return cut_lineage(rows.drop(*names).join(place, "text_key").withColumn("cell", F.lit(0)), "placed")


def _bin(key: Column) -> Column:
    """Bin of a 64-bit hash, by its top bits."""
    return F.shiftrightunsigned(key, 64 - (BINS.bit_length() - 1)).cast("int")


def _cut(sums: dict[int, int], target: float) -> tuple[int, float, float]:
    """(bin that holds the target, weight below it, its weight)."""
    below = 0
    for b in sorted(sums):
        if below + sums[b] >= target:
            return b, below, sums[b]
        below += sums[b]
    return max(sums) + 1, below, 0


def split(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard`` to measured rows."""
    spark = rows.sparkSession
    dims = [c for c in rows.columns if c.startswith("dim_")]
    cells = rows
    plan = {0: (0, shards)}  # cell -> (first shard, number of shards)
    while any(k > 1 for _, k in plan.values()):
        ranges = {r["cell"]: r for r in cells.groupBy("cell").agg(
            F.sum("size").alias("size"), *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        cuts, after = {}, {}
        for cell, (first, k) in plan.items():
            if cell in ranges and k > 1:
                r = ranges[cell]
                widest = max(dims, key=lambda c, r=r: r[f"hi_{c}"] - r[f"lo_{c}"])
                cuts[cell] = {"cell": cell, "dim": widest, "lo": r[f"lo_{widest}"], "span": (r[f"hi_{widest}"] - r[f"lo_{widest}"]) or 1.0,
                              "target": r["size"] * (k // 2) / k, "slack": SLACK * r["size"] / k, "b1": 0, "b2": 0, "b3": 0, "more": True}
            after[2 * cell], after[2 * cell + 1] = (first, max(1, k // 2)), (first + k // 2, k - k // 2)
        wide = spark.createDataFrame([(c["cell"], c["dim"], float(c["lo"]), float(c["span"])) for c in cuts.values()], "cell int, dim string, lo double, span double")
        value = F.coalesce(*[F.when(F.col("dim") == c, F.col(c)) for c in dims])
        scaled = F.least(F.lit(BINS - 1), F.floor((value - F.col("lo")) / F.col("span") * BINS)).cast("int")
        # Cells are at most as many as shards: a broadcast bounded by a parameter.
        at = (cells.join(F.broadcast(wide), "cell", "left").withColumn("bin1", scaled)
                   .withColumn("bin2", _bin(F.col("text_key"))).withColumn("bin3", _bin(F.xxhash64("row", F.lit(1)))).drop("dim", "lo", "span"))
        inside = F.col("bin1").isNotNull()
        for level in (1, 2, 3):
            todo = [c for c in cuts.values() if c["more"]]
            if not todo:
                break
            where = F.lit(False)
            for c in todo:
                where = where | ((F.col("cell") == c["cell"]) & (F.lit(True) if level == 1 else F.col("bin1") == c["b1"]) & (
                    F.lit(True) if level < 3 else F.col("bin2") == c["b2"]))
            sums: dict[int, dict[int, int]] = {}
            for r in at.where(inside & where).groupBy("cell", f"bin{level}").agg(F.sum("size").alias("size")).collect():
                sums.setdefault(r["cell"], {})[r[f"bin{level}"]] = r["size"]
            for c in todo:
                b, below, own = _cut(sums[c["cell"]], c["target"])
                # Cut at the nearer edge of the bin if that is close enough, else inside the bin.
                edge = b + (below + own - c["target"] <= c["target"] - below)
                off = min(abs(c["target"] - below), abs(below + own - c["target"]))
                if off <= c["slack"] or level == 3:
                    c[f"b{level}"], c["more"] = edge, False
                else:
                    c[f"b{level}"], c["target"] = b, c["target"] - below
        bounds = spark.createDataFrame([(c["cell"], int(c["b1"]), int(c["b2"]), int(c["b3"])) for c in cuts.values()], "cell int, b1 int, b2 int, b3 int")
        right = F.struct("bin1", "bin2", "bin3") >= F.struct("b1", "b2", "b3")
        cells = (at.join(F.broadcast(bounds), "cell", "left")
                   .withColumn("cell", (F.col("cell") * 2 + F.coalesce(right, F.lit(True)).cast("int")).cast("int"))
                   .drop("bin1", "bin2", "bin3", "b1", "b2", "b3"))
        plan = after
    if not plan or shards == 1:
        return cells.withColumn("shard", F.lit(0)).drop("cell")
    named = spark.createDataFrame([(c, first) for c, (first, _) in plan.items()], "cell int, shard int")
    return cells.join(F.broadcast(named), "cell").drop("cell")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents with shard and slot (see the module)."""
    s = cut_lineage(split(measured(docs), shards), "sharded")
    counts = s.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("part", "shard", F.coalesce(before, F.lit(0)).alias("shift"))
    ranked = s.withColumn("rank", F.row_number().over(Window.partitionBy("part", "shard").orderBy("row")) - 1)
    return ranked.join(shifts, ["part", "shard"]).withColumn("slot", F.col("rank") + F.col("shift"))


def op4(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                              F.lit(None).cast("int").alias("grown_shard"))
