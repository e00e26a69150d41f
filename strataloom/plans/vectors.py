"""Queries over vectors, their units and usage events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strataloom.operators import graph, knn
from strataloom.runtime import shared_folder
from strataloom.sources import load
from strataloom.streaming import usage


def _sets(spark, d):
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e


def j1_nearest(spark, d):
    """The five nearest rows of every query row."""
    return knn.nearest(*_sets(spark, d), 5).withColumn("score", F.round("score", 6))


def a7_merged(spark, d):
    """Hits of all queries from 0.35 on, merged: every row with its best score."""
    q, e = _sets(spark, d)
    return knn.best_of(knn.nearest(q, e, None, 0.35), "id").withColumn("score", F.round("score", 6))


def j4_cross(spark, d):
    """The five most similar rows of every source row from 0.3 on, each pair once."""
    q, e = _sets(spark, d)
    return knn.one_direction(knn.nearest(q, e, 5, 0.3), "query_id", "id", "score").withColumn("score", F.round("score", 6))


def a5_clusters(spark, d):
    """Clusters of the pairs from 0.35 on, with their scores and sizes."""
    q, e = _sets(spark, d)
    pairs = knn.nearest(q, e, 5, 0.35).select(F.col("query_id").alias("a"), F.col("id").alias("b"), "score")
    c = graph.components(pairs)
    size = c.groupBy("component").agg(F.count("*").alias("members"))
    s = pairs.join(c, pairs.a == c.id).groupBy("component").agg(F.round(F.min("score"), 6).alias("low"), F.round(F.max("score"), 6).alias("high"))
    return size.join(s, "component")


def a11_channels(spark, d):
    """Every channel with its entries, those that have a vector, and its state."""
    u = load(spark, d, "unit_vectors").distinct()
    v = load(spark, d, "vectors").where("vector IS NOT NULL").select("embedding_key", F.lit(1).alias("there")).distinct()
    n = u.join(v, "embedding_key", "left").groupBy("channel").agg(F.count("*").alias("entries"), F.count("there").alias("vectors"))
    names = spark.createDataFrame([(c,) for c in ("code", "config", "descriptions", "docs", "markup", "symbols")], "channel string")
    n = names.join(n, "channel", "left").na.fill(0, ["entries", "vectors"]).withColumn("pending", F.col("entries") - F.col("vectors"))
    return n.withColumn("state", F.when(F.col("entries") == 0, "empty").when(F.col("pending") > 0, "pending").otherwise("ready"))


def f22_missing(spark, d):
    """Units without a stored vector."""
    v = load(spark, d, "vectors").select("embedding_key", "profile_key")
    return load(spark, d, "unit_vectors").distinct().join(v, ["embedding_key", "profile_key"], "left_anti").select("unit_id", "channel", "embedding_key")


def j12_fanout(spark, d):
    """Keys that several units share, with their units."""
    u = load(spark, d, "unit_vectors").select("embedding_key", "channel", "unit_id").distinct()
    return u.groupBy("embedding_key", "channel").agg(F.count("*").alias("n_units"), F.min("unit_id").alias("first_unit")).where("n_units > 1")


def j18_unreachable(spark, d):
    """Stored vectors that neither code nor documents of any unit refer to."""
    live = load(spark, d, "unit_vectors").where("channel IN ('code', 'docs')").select("embedding_key", "profile_key")
    return load(spark, d, "vectors").select("embedding_key", "profile_key", "role").distinct().join(live, ["embedding_key", "profile_key"], "left_anti")


def a15_daily(spark, d):
    """Events and values by day and type."""
    return usage.daily_counts(load(spark, d, "events")).withColumn("total", F.round("total", 4))


def i9_stream(spark, d):
    """The same from a stream of the events table, run to its end."""
    at = f"{shared_folder(spark)}/strataloom-stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    static = load(spark, d, "events")
    src = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return usage.run_to_end(usage.daily_counts(src), f"{at}/out", f"{at}/state").withColumn("total", F.round("total", 4))


def a14_totals(spark, d):
    """Lifetime counters by event type."""
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))


def i9_sessions(spark, d):
    """Sessions of users, ended by two quiet hours."""
    return usage.sessions(load(spark, d, "events"), "user_id", "2 hours")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and k[0].islower() and k.split("_")[0][1:].isdigit()}

_COS = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"
_TOP = "t AS (SELECT * FROM s WHERE score >= {} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5)"
_DAILY = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"

ORACLES = {
    "j1_nearest": f"WITH {_COS}, {_TOP.format(-1)} SELECT query_id, id, round(score, 6) AS score FROM t",
    "a7_merged": f"WITH {_COS} SELECT id, round(max(score), 6) AS score FROM s WHERE score >= 0.35 GROUP BY 1",
    "j4_cross": f"WITH {_COS}, {_TOP.format(0.3)} SELECT query_id, id, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY least(query_id, id), greatest(query_id, id) ORDER BY query_id) = 1",
    "a5_clusters": f"""WITH RECURSIVE {_COS}, {_TOP.format(0.35)}, b AS (SELECT query_id AS a, id AS b FROM t UNION SELECT id, query_id FROM t), r AS (SELECT a AS id, a AS x FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.x),
 c AS (SELECT id, min(x) AS component FROM r GROUP BY 1) SELECT component, (SELECT count(*) FROM c d WHERE d.component = c.component) AS members, round(min(score), 6) AS low, round(max(score), 6) AS high FROM t JOIN c ON t.query_id = c.id GROUP BY component""",
    "a11_channels": """WITH n AS (SELECT channel, count(*) AS entries, count_if(embedding_key IN (SELECT embedding_key FROM vectors WHERE vector IS NOT NULL)) AS vectors FROM (SELECT DISTINCT * FROM unit_vectors) GROUP BY 1),
 m AS (SELECT c.channel, coalesce(entries, 0) AS entries, coalesce(vectors, 0) AS vectors FROM (SELECT unnest(['code','config','descriptions','docs','markup','symbols']) AS channel) c LEFT JOIN n USING (channel))
 SELECT *, entries - vectors AS pending, CASE WHEN entries = 0 THEN 'empty' WHEN entries > vectors THEN 'pending' ELSE 'ready' END AS state FROM m""",
    "f22_missing": "SELECT unit_id, channel, embedding_key FROM (SELECT DISTINCT * FROM unit_vectors) ANTI JOIN vectors USING (embedding_key, profile_key)",
    "j12_fanout": "SELECT embedding_key, channel, count(*) AS n_units, min(unit_id) AS first_unit FROM (SELECT DISTINCT embedding_key, channel, unit_id FROM unit_vectors) GROUP BY 1, 2 HAVING count(*) > 1",
    "j18_unreachable": "SELECT * FROM (SELECT DISTINCT embedding_key, profile_key, role FROM vectors) ANTI JOIN (SELECT * FROM unit_vectors WHERE channel IN ('code', 'docs')) USING (embedding_key, profile_key)",
    "a15_daily": _DAILY, "i9_stream": _DAILY,
    "a14_totals": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY 1",
    "i9_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, k""",
}
