"""Problem 10: documents with template residue, filler, error pages or script notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.residue import residue_scores, train
from strataloom.sources import load


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text holds residue in place of content."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs, "doc_id", "text", "repo")
    return residue_scores(docs, "doc_id", "text", model).where("residue").select(F.col("key").alias("doc_id"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that remain."""
    docs = load(spark, sf_dir, "documents")
    return docs.join(p10_found(spark, sf_dir), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the classifier on hosts held out from training."""
    v = train(load(spark, sf_dir, "documents"), "doc_id", "text", "repo").validation
    return spark.createDataFrame(sorted(v.items()), "figure string, value double")


QUERIES = {"p10_found": p10_found, "p10_clean": p10_clean, "p10_validation": p10_validation}
ORACLES: dict[str, str] = {}
