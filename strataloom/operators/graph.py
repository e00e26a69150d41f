"""Bounded traversal, components and closures over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import cut, drop, is_empty


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth): nodes within ``depth`` steps of the seeds along (src, dst), by their first visit.

    Cycles end because visited nodes are not visited again. Null ends lead nowhere.
    """
    seen = cut(seeds.select("id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        new = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).where("id IS NOT NULL").distinct()
        new = cut(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if is_empty(new):
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every node of an edge (a, b) with the smallest id of its component.

    Smallest labels pass over the edges, and labels are replaced by their own labels in each
    round, so long chains take a logarithmic number of rounds. Self links count as nodes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")))
    old = [label]
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("n"))
        low = label.join(near, "id").select("id", F.least("c", "n").alias("n"), F.col("c").alias("was"))
        # hook the old label's root too, then jump
        hook = low.groupBy(F.col("was").alias("id")).agg(F.min("n").alias("h"))
        up = cut(low.join(hook, "id", "left").select("id", F.least("n", F.coalesce("h", "n")).alias("n"), "was"))
        jump = up.select(F.col("id").alias("n"), F.col("n").alias("j"))
        new = cut(up.join(jump, "n", "left").select("id", F.least("n", F.coalesce("j", "n")).alias("c"), "was"))
        drop(*old, up)
        old, label = [new], new.select("id", "c")
        if is_empty(new.where("c <> was")):
            drop(both)
            return label.withColumnRenamed("c", "component")


def with_ancestors(nodes: DataFrame, matches: DataFrame, group: list[str]) -> DataFrame:
    """(group, id): the matches and all their ancestors (never their descendants).

    nodes: group, id, parent_id; matches: group, id. Repeated rows count once, circles end.
    """
    up = nodes.select(*group, "id", "parent_id").distinct()
    seen = cut(matches.select(*group, "id").distinct())
    frontier, parts = seen, [seen]
    while True:
        new = frontier.join(up, [*group, "id"]).where("parent_id IS NOT NULL").select(*group, F.col("parent_id").alias("id")).distinct()
        new = new.join(up.select(*group, "id").distinct(), [*group, "id"], "left_semi")
        for p in parts:
            new = new.join(p, [*group, "id"], "left_anti")
        new = cut(new)
        if is_empty(new):
            return reduce(DataFrame.unionByName, parts)
        parts = [cut(reduce(DataFrame.unionByName, [*parts, new]))]
        frontier = new
