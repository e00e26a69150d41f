"""Order-dependent columns of declarations and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def occurrences(df: DataFrame, group: list[str], name: str, order: list[str]) -> DataFrame:
    """``df`` with ``occurrence``: the how-manieth row of the same name within the group, from 0."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*group, name).orderBy(*order)) - 1)


def section_ends(df: DataFrame, group: list[str], start: str, level: str, last: str) -> DataFrame:
    """``df`` with ``body_end`` and ``section_end``, both inclusive lines.

    The body ends before the next heading, the section before the next one of the same or a
    higher rank; both end with ``last`` where none follows. For each level the next heading
    at or above it is the least start among the later ones, kept by one window per level.
    """
    order = Window.partitionBy(*group).orderBy(start).rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.min(F.when(F.col(level) <= n, F.col(start))).over(order) for n in range(1, 7)]
    after = F.element_at(F.array(*nexts), F.col(level).cast("int"))
    body = F.lead(start).over(Window.partitionBy(*group).orderBy(start))
    return df.withColumns({"body_end": F.coalesce(body - 1, F.col(last)), "section_end": F.coalesce(after - 1, F.col(last))})
