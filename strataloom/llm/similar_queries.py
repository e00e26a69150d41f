"""Problem 2: most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.similar import most_similar
from strataloom.sources import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each usable vector its at most five nearest others of its profile, cosine 0.9 or more."""
    near = most_similar(load(spark, sf_dir, "vectors"), "embedding_key", "vector", "profile_key")
    return near.select(F.col("key").alias("embedding_key"), F.col("neighbor").alias("neighbor_key"))


QUERIES = {"p2_found": p2_found}

#: Brute force. The search is approximate: that it finds the same on the test tables says that their pairs lie where recall is high.
ORACLES = {
    "p2_found": """WITH d AS (SELECT profile_key, len(vector) AS n FROM vectors WHERE len(vector) > 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY profile_key ORDER BY count(*) DESC, n) = 1),
 v AS (SELECT DISTINCT profile_key, embedding_key, CAST(vector AS DOUBLE[]) AS x FROM vectors JOIN d USING (profile_key) WHERE len(vector) = n AND embedding_key IS NOT NULL
   AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0),
 c AS (SELECT a.profile_key, a.embedding_key, b.embedding_key AS neighbor_key, round(list_cosine_similarity(a.x, b.x), 4) AS c FROM v a JOIN v b ON a.profile_key = b.profile_key AND a.embedding_key <> b.embedding_key WHERE c >= 0.9)
 SELECT embedding_key, neighbor_key FROM c QUALIFY row_number() OVER (PARTITION BY profile_key, embedding_key ORDER BY c DESC, neighbor_key) <= 5""",
}
