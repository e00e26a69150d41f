"""Problem 5: source files that do not parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.syntax import invalid_files
from strataloom.sources import current_files, load


def _faults(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = current_files(load(spark, sf_dir, "files"), ["hash", "language"])
    return files, invalid_files(files, load(spark, sf_dir, "sources"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files whose text is not valid for their extension."""
    return _faults(spark, sf_dir)[1].select("repo", "path")


def p5_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each of those files."""
    return _faults(spark, sf_dir)[1].select("repo", "path", "syntax", "line", "message")


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files by repository and language."""
    files, bad = _faults(spark, sf_dir)
    bad = bad.select(F.col("repo").alias("bad_repo"), F.col("path").alias("bad_path"), F.lit(1).alias("bad"))
    at = files.join(bad, F.col("repo").eqNullSafe(F.col("bad_repo")) & F.col("path").eqNullSafe(F.col("bad_path")), "left").select("repo", "language", "bad")
    out = at.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("bad").alias("n_invalid"))
    return out.withColumn("rate", F.col("n_invalid") / F.col("n_files"))


QUERIES = {"p5_found": p5_found, "p5_diagnostics": p5_diagnostics, "p5_rates": p5_rates}
ORACLES: dict[str, str] = {}
