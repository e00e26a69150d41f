"""Problem 3: clusters of similar code units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.clusters import Clusters, describe, unit_clusters
from strataloom.sources import load

CHANNEL, PROFILE = "code", "hashvec-64-a"


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Clusters]:
    units = load(spark, sf_dir, "unit_vectors").where(f"channel = '{CHANNEL}' AND profile_key = '{PROFILE}'")
    vectors = load(spark, sf_dir, "vectors").where(f"profile_key = '{PROFILE}'")
    return unit_clusters(units.select("unit_id", "embedding_key"), vectors)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that share a cluster with another unit, by the cluster's smallest unit."""
    return _clusters(spark, sf_dir)[0].select("unit_id", "cluster_id")


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every cluster of two units or more."""
    return describe(*_clusters(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_clusters": p3_clusters}

ORACLES = {
    "p3_found": """WITH RECURSIVE d AS (SELECT len(vector) AS n FROM vectors WHERE profile_key = 'hashvec-64-a' AND len(vector) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
 u AS (SELECT unit_id, min(embedding_key) AS embedding_key FROM unit_vectors WHERE channel = 'code' AND profile_key = 'hashvec-64-a' GROUP BY 1),
 v AS (SELECT DISTINCT embedding_key, CAST(vector AS DOUBLE[]) AS x FROM vectors JOIN d ON len(vector) = n WHERE profile_key = 'hashvec-64-a'
       AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(vector, lambda e: e <> 0)) > 0
       AND embedding_key IN (SELECT embedding_key FROM u)),
 e AS (SELECT a.embedding_key AS a, b.embedding_key AS b FROM v a JOIN v b ON round(list_cosine_similarity(a.x, b.x), 4) >= 0.9),
 r AS (SELECT a AS k, b AS to_key FROM e UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.to_key),
 l AS (SELECT k, min(to_key) AS label FROM r GROUP BY k),
 m AS (SELECT unit_id, label FROM u JOIN l ON u.embedding_key = l.k)
 SELECT unit_id, min(unit_id) OVER (PARTITION BY label) AS cluster_id FROM m QUALIFY count(*) OVER (PARTITION BY label) > 1""",
}
