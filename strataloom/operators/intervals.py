"""Line and byte ranges: merging and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_ranges(df: DataFrame, keys: list[str], start: str, end: str, touching: int = 1) -> DataFrame:
    """(keys, start, end): overlapping ranges of a key, and those at most ``touching`` apart, become one.

    Gaps and islands: a range opens an island if it starts beyond the largest end before it.
    Rows with a null bound and reversed ranges are left out; repeated ranges change nothing.
    """
    rows = df.where(F.col(start).isNotNull() & (F.col(end) >= F.col(start))).select(*keys, F.col(start).alias("s"), F.col(end).alias("e")).distinct()
    order = Window.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("island", F.sum(F.when(F.col("s") <= before + touching, 0).otherwise(1)).over(order))
    return rows.groupBy(*keys, "island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")


def covered_lines(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, lines): how many lines the ranges of a key cover together."""
    m = merge_ranges(df, keys, start, end)
    return m.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start) + 1).alias("lines"))
