"""Session helpers: build a session for tests/bench, and resolve shared paths.

Cluster jobs must cut lineage into the shared folder the cluster names in
``spark.checkpoint.dir``; we only set our own value when it is unset (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Map state and timers of streaming operators.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Window top-k (row_number <= k) gets a partial limit before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(master: str | None = None, cpus: int | None = None,
                shuffle_partitions: int | None = None, app: str = "logsift") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided one."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the session names.

    Only a local session may go without one: it gets a temporary folder. On a
    cluster a machine-local folder would be read back empty, so that is an
    error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="logsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str | None = None, tight: bool = False) -> DataFrame:
    """Reliable lineage cut: write to the shared checkpoint folder and read back.

    Unlike ``localCheckpoint`` this survives executor loss, because the data
    lives in the cluster's shared folder, not in executor block managers.
    ``tight`` is for large tables of text: they are packed closer, and the
    shuffle files of this write go with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name or "cut")
    if tight:
        before = spark.conf.get(SHUFFLE_CLEANUP, None)
        spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(path, compression="zstd")
        finally:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    else:
        df.write.parquet(path)
    out = spark.read.parquet(path)
    out.scratch = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` that nothing reads any more."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
