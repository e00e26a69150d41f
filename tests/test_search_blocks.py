"""Hits that are reduced where they are found, against all hits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom import plans
from strataloom.operators import knn, search

FOLDER = "/root/testdata/sf0.001"
NAMES = [f"k{i:03}" for i in range(300)]


@pytest.fixture(scope="module")
def tables(spark):
    """(queries, units, vectors): many equal vectors, units with several keys and channels, keys of no unit, one without id, one infinite."""
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, (300, 4)).astype(float)
    x[5], x[6, 0] = 0, float("inf")
    v = spark.createDataFrame([*zip(NAMES, x.tolist(), strict=True), (None, [1.0, 0.0, 0.0, 0.0])], "key string, vector array<double>")
    u = {(int(r.integers(0, 120)), str(r.choice(["code", "descriptions", "docs", "symbols"])), str(r.choice(NAMES[:250]))) for _ in range(400)}
    u = spark.createDataFrame([*u, (None, "docs", "k001"), (None, "code", "k002"), (7, None, "k003"), (500, "docs", None)], "unit_id long, channel string, key string")
    return v.where("key IS NOT NULL AND key < 'k040'").withColumnRenamed("key", "query_id"), u, v


def both(a, b):
    key = lambda r: tuple(str(c) for c in r)
    return sorted(map(key, a.collect())), sorted(map(key, b.collect()))


@pytest.mark.parametrize("block, most", [(1024, 1 << 16), (7, 1 << 16), (7, 15)])
def test_reduced_hits(spark, tables, monkeypatch, block, most):
    q, u, v = tables
    for name in ("best_query", "top_units", "best_in_channel"):
        f = getattr(knn, name)
        monkeypatch.setattr(knn, name, lambda *a, f=f: f(*a, most=most, block=block))
    hits = search.unit_hits(q, u, v.where("key IS NOT NULL"), 0.3).cache()
    columns = ["query_id", "unit_id", "channel", "score"]
    got, want = both(search.merged_hits(q, u, v, 0.3).select(columns), search.merged(hits, ["unit_id"], ["query_id"]).select(columns))
    assert got == want and len(got) > 100
    for limit in (3, 1000):
        got, want = both(*(search.limited(h, ["unit_id"], limit, ["query_id"]).select(*columns, "rank", "omitted") for h in (search.top_hits(q, u, v, limit, 0.3), hits)))
        assert got == want and len(got) > 100
    for channel in ("code", "docs", "symbols"):
        got, want = both(search.channel_hits(q, u, v, channel, 0.3).select("unit_id", "score"), hits.where((F.col("channel") == channel) & F.col("unit_id").isNotNull()).groupBy("unit_id").agg(F.max("score")))
        assert got == want and got
    none = q.limit(0)
    assert search.merged_hits(none, u, v).count() == search.top_hits(none, u, v, 3).count() == search.channel_hits(none, u, v, "docs").count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name, blocks", [("a10_inspect", 0), ("a7_search", 0), ("j1_search", 0), ("u1_union", 2), ("a16_articles", 0), ("f24_expanded", 0), ("a20_by_file", 0), ("t6_reranked", 0)])
def test_no_vectors_by_blocks(spark, name, blocks):
    """Vectors are not multiplied by the number of query blocks; the two left in u1_union search with three texts."""
    plan = plans.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == blocks


def test_ranks(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "a int, b int")
    assert all(r["rank"] == 101 - r.a for r in search.ranks(df, "rank", [F.desc("a")], 5).collect())
    assert search.ranks(df.limit(0), "rank", ["a"], 5).count() == 0


def test_inspect_has_every_entry(spark, tmp_path):
    n = search.LIMIT + 100
    c = spark.range(n).select(F.col("id").alias("unit_id"), F.concat(F.lit("p"), -F.col("id")).alias("path"), F.lit("load").alias("name"), F.lit("def load(x):").alias("source"))
    c.union(c.limit(5).withColumn("source", F.lit("def merge(x):"))).write.parquet(f"{tmp_path}/callables.parquet")
    v = [("a", "hashvec-64-a", "query", [1.0] * 64), ("b", "hashvec-64-a", "document", [2.0] * 64)]
    spark.createDataFrame(v, "embedding_key string, profile_key string, role string, vector array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    spark.createDataFrame([(n - 1, "code", "hashvec-64-a", "b")], "unit_id long, channel string, profile_key string, embedding_key string").write.parquet(f"{tmp_path}/unit_vectors.parquet")
    got = plans.queries()["a10_inspect"](spark, str(tmp_path)).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, n + 1)) and [r.unit_id for r in got] == [n - 1, *range(n - 1)]
    assert [r.path for r in sorted(got, key=lambda r: r.original)] == sorted(r.path for r in got)
