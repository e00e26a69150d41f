"""Problems 8 and 9: containers of documents, and mixtures of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.mixing import Mixture, mix_sources
from strataloom.llm.packing import fill_containers
from strataloom.llm.tokens import token_counts
from strataloom.sources import load

CAPACITY = 2048


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every document lies in containers of 2,048 tokens."""
    sizes = token_counts(load(spark, sf_dir, "documents"), "doc_id", "text")
    return fill_containers(sizes, "key", "n_tokens", CAPACITY).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are and how full they are."""
    at = p8_containers(spark, sf_dir).where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return at.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / F.count("*") / CAPACITY).alias("filled"), F.max("n").alias("fullest"))


def _mixture(spark: SparkSession, sf_dir: str) -> Mixture:
    sizes = token_counts(load(spark, sf_dir, "documents"), "doc_id", "text", also=("source",))
    return mix_sources(sizes, load(spark, sf_dir, "mix_targets"))


def p9_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected pieces of documents, slot by slot."""
    return _mixture(spark, sf_dir).selection.withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of tokens that each source reaches."""
    return _mixture(spark, sf_dir).shares


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p9_selection": p9_selection, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
