"""Call edges between functions, resolved only where the target is certain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_edges(callables: DataFrame) -> DataFrame:
    """(src, dst) of unit ids: ``src`` calls a name that exactly one unit of its repository has.

    callables: unit_id, repo, name, source. Call sites are words before a parenthesis. A name
    of several units makes no edge; calls of itself make one.
    """
    # names are taken from the texts before repeats are dropped, so no text is shuffled
    only = callables.where("name IS NOT NULL").groupBy("repo", "name").agg(F.min("unit_id").alias("dst"), F.count_distinct("unit_id").alias("n")).where("n = 1")
    sites = callables.select(F.col("unit_id").alias("src"), "repo", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), F.lit(1)))).alias("name")).distinct()
    return sites.join(only, ["repo", "name"]).select("src", "dst").distinct()
