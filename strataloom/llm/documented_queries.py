"""Problem 4: code and description pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.documented import delimited_sources, documented_callables, pairs
from strataloom.sources import current_files, load


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return current_files(load(spark, sf_dir, "files"), ["hash"]), load(spark, sf_dir, "sources"), load(spark, sf_dir, "callables")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callables whose documentation tells something about them."""
    return documented_callables(*_tables(spark, sf_dir)).where("says").select("unit_id").distinct()


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source, signature and description of those callables."""
    return pairs(*_tables(spark, sf_dir))


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every callable as the windows over tokens delimit it, documented or not."""
    files, sources, callables = _tables(spark, sf_dir)
    at = delimited_sources(documented_callables(files, sources, callables), sources)
    return at.select("unit_id", F.sha2("source", 256).alias("source_hash")).distinct()


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_sources": p4_sources}
ORACLES = {"p4_sources": "SELECT DISTINCT unit_id, sha256(source) AS source_hash FROM callables"}
