"""Small column helpers shared by the operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A word once A-Z are lower-cased: digits, a-z and everything beyond ASCII.
WORD_SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WHITE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, in any collation and locale."""
    return F.when(c.rlike("[A-Z]"), F.translate(c, UPPER, LOWER)).otherwise(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column, kind: str = "bigint") -> Column:
    """Sum of an array column."""
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def fresh(df: DataFrame, name: str) -> str:
    """A column name the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def share(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast an object of this package; its class travels along, as executors may lack the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shared(value: Broadcast) -> Any:
    return pickle.loads(value.value)
