"""Size guards for broadcasts.

A side is broadcast only when its size is proven small: either bounded by
construction (configuration, per-query parameters) or measured here against
a row and byte budget. Callers get ``None`` back when the bound is exceeded
and must take their non-broadcast path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate (from file sizes and projections), if known."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except (AttributeError, NotImplementedError):  # a session without the JVM classes (Spark Connect): counted instead
        return None


def bounded_rows(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> int | None:
    """Exact row count if it is <= max_rows, else None (reads at most max_rows+1)."""
    n = df.limit(max_rows + 1).count()
    return n if n <= max_rows else None


def checked_broadcast(df: DataFrame, what: str, max_rows: int = MAX_BROADCAST_ROWS,
                      max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame | None:
    """``broadcast(df)`` if df is proven small, else None."""
    est = estimated_bytes(df)
    if est is not None and est <= max_bytes:
        return F.broadcast(df)
    n = bounded_rows(df, max_rows)
    if n is None:
        return None
    width = max(1, len(df.columns)) * 64
    if n * width > max_bytes:
        return None
    return F.broadcast(df)
