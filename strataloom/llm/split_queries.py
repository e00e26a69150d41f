"""Problem 7: oversized Markdown sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.split import split_oversized
from strataloom.sources import load


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections over 8,192 bytes or 120 lines, as those that came out in several pieces."""
    return split_oversized(load(spark, sf_dir, "markdown_chunks")).where("pieces > 1").select("unit_id").distinct()


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections, cut to size."""
    out = split_oversized(load(spark, sf_dir, "markdown_chunks"))
    return out.select("unit_id", "heading_path", "start_line", "end_line", "content", "piece", "pieces", F.octet_length("content").alias("n_bytes"))


def p7_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections put together again from their pieces without what these repeat, and whether all pieces keep the limits."""
    m = load(spark, sf_dir, "markdown_chunks").groupBy("unit_id").agg(F.min(F.struct("content", "start_line", "end_line")).alias("c")).select("unit_id", "c.*")
    out = split_oversized(m).withColumn("own", F.expr("substring(content, overlap_chars + 1)"))
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n") | (F.length("content") == 0), 0).otherwise(1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "own"))), lambda x: x.own), "")
    return out.groupBy("unit_id").agg(F.sha2(text, 256).alias("whole"), F.bool_and((F.octet_length("content") <= 8192) & (lines <= 120)).alias("fits"))


QUERIES = {"p7_rebuilt": p7_rebuilt, "p7_found": p7_found, "p7_pieces": p7_pieces}

ORACLES = {
    "p7_rebuilt": "SELECT unit_id, sha256(min(content)) AS whole, true AS fits FROM markdown_chunks GROUP BY 1",
    "p7_found": """SELECT DISTINCT unit_id FROM markdown_chunks WHERE strlen(content) > 8192
 OR length(content) - length(replace(content, chr(10), '')) + CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 0 ELSE 1 END > 120"""
}
