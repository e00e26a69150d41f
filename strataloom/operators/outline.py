"""What a map of declarations shows: ancestors, privacy, hunks, references and heading paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.operators.graph import with_ancestors
from strataloom.operators.hierarchy import hierarchy
from strataloom.runtime import cut, is_empty


def closure(nodes: DataFrame, matches: DataFrame, group: list[str]) -> DataFrame:
    """(group, id): the matches and all their ancestors, never unmatched children.

    Ancestors are read off the hierarchy's paths, which take tens of joins for trees of hundreds
    of levels; only matches on or below a circle of parents are followed step by step.
    """
    h = hierarchy(nodes, group)
    m = matches.select(*group, "id").distinct()
    up = h.nodes.join(m, [*group, "id"], "left_semi").select(*group, F.explode("ids").alias("id"))
    around = with_ancestors(h.cyclic.select(*group, "id", "parent_id"), m.join(h.cyclic, [*group, "id"], "left_semi"), group)
    return up.unionByName(around).distinct()


def inherited(nodes: DataFrame, group: list[str], flag: str, passes_on: Column) -> DataFrame:
    """(group, id, flag): rows that carry the flag themselves or below an ancestor that passes it on.

    nodes: group, id, parent_id, name and the boolean ``flag``. On and below circles of parents the flag goes
    on step by step until no row changes.
    """
    h = hierarchy(nodes, group)
    own = nodes.groupBy(*group, "id").agg(F.max(flag).alias("_own"), F.max(F.coalesce(F.col(flag) & passes_on, F.lit(False))).alias("_on"))
    up = h.nodes.select(*group, "id", F.explode("ids").alias("a")).where("a <> id")
    up = up.join(own.where("_on").select(*group, F.col("id").alias("a")), [*group, "a"], "left_semi").select(*group, "id").distinct()
    # circles of parents: few rows
    around = cut(h.cyclic.select(*group, "id", "parent_id"))
    on = own.where("_on").select(*group, F.col("id").alias("parent_id"))
    found = cut(around.join(on, [*group, "parent_id"], "left_semi").select(*group, "id").distinct())
    parts = [found]
    while not is_empty(found):
        found = around.join(found.withColumnRenamed("id", "parent_id"), [*group, "parent_id"], "left_semi").select(*group, "id").distinct()
        found = cut(found.join(reduce(DataFrame.unionByName, parts), [*group, "id"], "left_anti"))
        parts.append(found)
    up = reduce(DataFrame.unionByName, [up, *parts]).distinct().withColumn("_up", F.lit(True))
    return own.join(up, [*group, "id"], "left").select(*group, "id", (F.coalesce("_own", F.lit(False)) | F.coalesce("_up", F.lit(False))).alias(flag))


def hunks(nodes: DataFrame, group: list[str], chosen: str, gap: int = 4) -> DataFrame:
    """The chosen nodes with ``hunk``: neighbours in one scope share one.

    nodes: group, id, parent_id, start_line, end_line, heading_level and the boolean ``chosen``. A node
    joins the one before it if no sibling between was left out, at most ``gap`` lines lie between,
    and both or neither are headings. Hunks are numbered through a scope from 0.
    """
    scope = Window.partitionBy(*group, "parent_id").orderBy("start_line", "id")
    heads = F.col("heading_level").isNotNull()
    rows = nodes.withColumns({"_left_out": F.sum(F.when(~F.col(chosen), 1).otherwise(0)).over(scope)}).where(chosen)
    near = (F.col("start_line") - F.lag("end_line").over(scope) - 1 <= gap) & (F.lag("_left_out").over(scope) == F.col("_left_out")) & (F.lag(heads).over(scope) == heads)
    rows = rows.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("hunk", F.sum("_new").over(scope) - 1).drop("_new", "_left_out")


def heading_paths(heads: DataFrame, group: list[str]) -> DataFrame:
    """Headings (group, id, name, start_line, heading_level) with ``heading_path``: the titles of the open headings above and its own.

    A heading of a lower number is open if none of that number or below has come since. One window finds
    the last heading of each level, so no heading is joined with another.
    """
    before = Window.partitionBy(*group).orderBy("start_line", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("heading_level") == n, F.struct("start_line", "id", "name"))).over(before) for n in range(1, 7)]
    rows = heads.withColumns({f"_h{n}": x for n, x in enumerate(last, 1)})
    open_, seen = [], F.lit(0)
    for n in range(1, 7):
        h = F.col(f"_h{n}")
        open_.append(F.when((F.col("heading_level") > n) & (h.start_line > seen), h["name"]))
        seen = F.greatest(seen, F.coalesce(h.start_line, F.lit(0)))
    return rows.withColumn("heading_path", F.concat(F.array_compact(F.array(*open_)), F.array("name"))).drop(*[f"_h{n}" for n in range(1, 7)])


def innermost(points: DataFrame, ranges: DataFrame, group: list[str], at: str, start: str, end: str, key: str) -> DataFrame:
    """``points`` with ``owner``: the key of the smallest range of the group with start <= at < end, ties to the smaller key."""
    p, r = points.alias("p"), ranges.select(*group, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(key).alias("_k")).distinct().alias("r")
    on = [F.col(f"p.{g}") == F.col(f"r.{g}") for g in group]
    cond = (F.col("_s") <= F.col(f"p.{at}")) & (F.col(f"p.{at}") < F.col("_e"))
    for c in on:
        cond = cond & c
    both = p.join(r, cond, "left").select(*[F.col(f"p.{c}").alias(c) for c in points.columns], "_s", "_e", "_k")
    best = F.min(F.when(F.col("_k").isNotNull(), F.struct((F.col("_e") - F.col("_s")).alias("n"), F.col("_k").alias("k"))))
    return both.groupBy(*points.columns).agg(best.alias("b")).select(*points.columns, F.col("b.k").alias("owner"))


def reach_each(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, depth): what each seed reaches within ``depth`` steps along (src, dst), itself left out, by first visit."""
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    frontier = cut(seeds.select(F.col("id").alias("seed"), "id").where("id IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    parts = [frontier]
    for n in range(1, depth + 1):
        new = frontier.select("seed", F.col("id").alias("src")).join(e, "src").select("seed", F.col("dst").alias("id")).distinct()
        new = cut(new.join(reduce(DataFrame.unionByName, parts).select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(n)))
        if is_empty(new):
            break
        parts.append(new)
        frontier = new
    return reduce(DataFrame.unionByName, parts).where("depth > 0")
