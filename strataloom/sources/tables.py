"""The engine's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current_files(files: DataFrame, columns: list[str]) -> DataFrame:
    """The latest version of each (repo, path), one row per file.

    A file that was indexed again keeps its earlier row; the row with the latest
    ``indexed_at`` counts (a null is older than any time). Rows that tie on it are
    settled by the largest values of ``columns``, so exact repeats collapse. The
    maximum is a partial aggregate: nothing but one row per file and task is shuffled.
    """
    row = F.struct(F.col("indexed_at").alias("_at"), *[F.col(c) for c in columns])
    best = files.groupBy("repo", "path").agg(F.max(row).alias("_row"))
    return best.select("repo", "path", *[F.col(f"_row.{c}").alias(c) for c in columns])
