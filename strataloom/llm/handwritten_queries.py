"""Problem 1: files that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.handwritten import not_handwritten
from strataloom.sources import current_files, load


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = current_files(load(spark, sf_dir, "files"), ["hash", "language", "source_mode"])
    return not_handwritten(files, load(spark, sf_dir, "sources"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files that are generated, minified, third-party copies or data saved as code."""
    return _judged(spark, sf_dir).where("reason IS NOT NULL").select("repo", "path")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by language, source mode and reason; a null reason counts the hand-written ones."""
    return _judged(spark, sf_dir).groupBy("language", "source_mode", "reason").agg(F.count("*").alias("n_files"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
ORACLES: dict[str, str] = {}
