"""Problem 6: hierarchies of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.hierarchy import Hierarchy, hierarchy
from strataloom.sources import load

GROUP = ["repo", "path"]


def _trees(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return hierarchy(load(spark, sf_dir, "symbols"), GROUP)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols on or below a circle of parents, with the smallest id on that circle."""
    return _trees(spark, sf_dir).cyclic.select("repo", "path", "id", "cycle_id")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full path of names, depth and root of every symbol that a root reaches."""
    n = _trees(spark, sf_dir).nodes
    full = F.array_join("name_path", ".", "?")
    return n.select("repo", "path", "id", "root_id", "depth", full.alias("full_path"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance."""
    return _trees(spark, sf_dir).descendants()


QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

_ROWS = """WITH RECURSIVE s AS (SELECT DISTINCT repo, path, id, parent_id, name FROM symbols),
 e AS (SELECT a.repo, a.path, a.id, a.name, CASE WHEN b.id IS NULL THEN NULL ELSE a.parent_id END AS parent_id
       FROM s a LEFT JOIN (SELECT DISTINCT repo, path, id FROM s) b ON a.repo = b.repo AND a.path = b.path AND a.parent_id = b.id),
 t AS (SELECT repo, path, id, id AS root_id, 0 AS depth, coalesce(name, '?') AS full_path, [id] AS ids FROM e WHERE parent_id IS NULL
       UNION ALL
       SELECT e.repo, e.path, e.id, t.root_id, t.depth + 1, t.full_path || '.' || coalesce(e.name, '?'), list_append(t.ids, e.id)
       FROM e JOIN t ON e.repo = t.repo AND e.path = t.path AND e.parent_id = t.id)"""

ORACLES = {
    "p6_found": _ROWS
    + """, u AS (SELECT e.repo, e.path, e.id, e.parent_id FROM e LEFT JOIN t ON e.repo = t.repo AND e.path = t.path AND e.id = t.id WHERE t.id IS NULL),
 up AS (SELECT repo, path, id, id AS cur, 0 AS n FROM u
        UNION ALL
        SELECT up.repo, up.path, up.id, u.parent_id, n + 1 FROM up JOIN u ON up.repo = u.repo AND up.path = u.path AND up.cur = u.id
        WHERE n < 2 * (SELECT max(c) FROM (SELECT count(*) AS c FROM u GROUP BY repo, path)))
 SELECT repo, path, id, min(cur) AS cycle_id FROM up
 WHERE n >= (SELECT max(c) FROM (SELECT count(*) AS c FROM u GROUP BY repo, path)) GROUP BY repo, path, id""",
    "p6_paths": _ROWS + " SELECT repo, path, id, root_id, depth, full_path FROM t",
    "p6_descendants": _ROWS
    + """, x AS (SELECT repo, path, id, depth, unnest(ids) AS ancestor_id, generate_subscripts(ids, 1) - 1 AS a FROM t)
 SELECT repo, path, ancestor_id, id, CAST(depth - a AS INTEGER) AS distance FROM x WHERE a < depth""",
}
