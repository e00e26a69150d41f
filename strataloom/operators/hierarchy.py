"""Parent-child rows to full hierarchies: paths, depths, roots, descendants, cycles.

Level-wise frontier joins start at the roots. The first levels, which hold nearly all
rows of flat trees, are joined one by one and leave the remaining rows ever fewer; what
is deeper is joined in strides: ancestor pairs of the remaining rows up to ``stride``
levels apart are built by doubling, and one frontier join then reaches ``stride`` levels
at once. Rows that no frontier reaches lie on or below a circle of parents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import cut, drop, is_empty


@dataclass
class Hierarchy:
    """nodes: group columns, id, parent_id, name, root_id, depth, name_path (names from
    the root), ids (ids from the root); reached rows only. cyclic: group columns, id,
    parent_id, name, cycle_id; the rows on or below a circle."""

    nodes: DataFrame
    cyclic: DataFrame
    group: list[str]

    def descendants(self) -> DataFrame:
        """(group, ancestor_id, id, distance) for every proper ancestor of every node."""
        n = self.nodes.select(*self.group, "id", "depth", F.posexplode("ids").alias("at", "ancestor_id"))
        return n.where("at < depth").select(
            *self.group, "ancestor_id", "id", (F.col("depth") - F.col("at")).alias("distance")
        )

    def descendant_counts(self) -> DataFrame:
        """(group, id, descendants) for every reached node, zero for leaves."""
        # every node counts itself once and one for each proper ancestor
        n = self.nodes.select(*self.group, F.explode("ids").alias("id"))
        return n.groupBy(*self.group, "id").agg((F.count("*") - 1).alias("descendants"))


def _same(a: str, b: str, group: list[str], *pairs: tuple[str, str]) -> Column:
    on = [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in group]
    return reduce(Column.__and__, on + [F.col(f"{a}.{x}") == F.col(f"{b}.{y}") for x, y in pairs])


def hierarchy(
    df: DataFrame,
    group: list[str],
    id_col: str = "id",
    parent_col: str = "parent_id",
    name_col: str = "name",
    levels: int = 4,
    stride: int = 16,
) -> Hierarchy:
    """Resolve the trees of each group.

    A row whose parent is null or names no row of its group is a root. Repeated rows of
    one (group, id) count once; where they differ, the one with the smallest
    (parent, name), nulls first, holds. Rows with a null id can be no node and are left
    out. Null group values form groups of their own. A null name stays null in ``name_path``.
    Other columns of ``df`` are ignored, whatever their names; an empty table gives
    empty results. ``levels`` and ``stride`` change only the number of joins.
    """
    rows = df.where(F.col(id_col).isNotNull()).groupBy(*group, F.col(id_col).alias("id"))
    rows = rows.agg(F.min(F.struct(F.col(parent_col).alias("p"), F.col(name_col).alias("n"))).alias("_r"))
    rows = rows.select(*group, "id", F.col("_r.p").alias("parent_id"), F.col("_r.n").alias("name"))
    there = rows.select(*group, "id").alias("b")
    base = rows.alias("a").join(there, _same("a", "b", group, ("parent_id", "id")), "left")
    base = cut(
        base.select(*[f"a.{g}" for g in group], "a.id", "a.parent_id", "a.name", F.col("b.id").isNull().alias("top"))
    )
    cols = [*group, "id", "parent_id", "name", "root_id", "depth", "name_path", "ids"]
    frontier = base.where("top").select(
        *group, "id", "parent_id", "name", F.col("id").alias("root_id"), F.lit(0).alias("depth"),
        F.array("name").alias("name_path"), F.array("id").alias("ids"),
    )
    reached, rest = [frontier], base.where("not top").drop("top")
    for _ in range(levels):
        new = rest.alias("a").join(frontier.alias("f"), _same("a", "f", group, ("parent_id", "id")))
        new = cut(
            new.select(
                *[f"a.{g}" for g in group], "a.id", "a.parent_id", "a.name", "f.root_id", (F.col("f.depth") + 1).alias("depth"),
                F.concat("f.name_path", F.array("a.name")).alias("name_path"), F.concat("f.ids", F.array("a.id")).alias("ids"),
            )
        )
        left = cut(rest.alias("a").join(new.select(*group, "id").alias("n"), _same("a", "n", group, ("id", "id")), "left_anti"))
        drop(rest)
        rest = left
        if is_empty(new):
            frontier = None
            break
        reached.append(new)
        frontier = new
        if is_empty(rest):
            frontier = None
            break
    if frontier is not None:
        deep = _strides(rest, frontier, group, stride)
        reached += deep
        done = reduce(DataFrame.unionByName, [d.select(*group, "id") for d in deep])
        rest = cut(rest.alias("a").join(done.alias("n"), _same("a", "n", group, ("id", "id")), "left_anti"))
    nodes = reduce(DataFrame.unionByName, [r.select(*cols) for r in reached])
    return Hierarchy(nodes, _cycles(rest, group), group)


def _strides(rest: DataFrame, frontier: DataFrame, group: list[str], stride: int) -> list[DataFrame]:
    g = [f"a.{c}" for c in group]
    hops = rest.select(
        *group, "id", "parent_id", "name", F.col("parent_id").alias("over"), F.lit(1).alias("far"),
        F.array("name").alias("names"), F.array("id").alias("between"),
    )
    k, size = 1, 1
    while size < stride:
        longer = hops.where(F.col("far") == k).alias("a").join(hops.alias("b"), _same("a", "b", group, ("over", "id")))
        longer = longer.select(
            *g, "a.id", "a.parent_id", "a.name", "b.over", (F.col("a.far") + F.col("b.far")).alias("far"),
            F.concat("b.names", "a.names").alias("names"), F.concat("b.between", "a.between").alias("between"),
        )
        old, hops = hops, cut(hops.unionByName(longer))
        drop(old)
        k = size = 2 * k
    out: list[DataFrame] = []
    while frontier is not None:
        new = hops.alias("a").join(frontier.alias("f"), _same("a", "f", group, ("over", "id")))
        new = cut(
            new.select(
                *g, "a.id", "a.parent_id", "a.name", "f.root_id", (F.col("f.depth") + F.col("a.far")).alias("depth"),
                F.concat("f.name_path", "a.names").alias("name_path"), F.concat("f.ids", "a.between").alias("ids"), "a.far",
            )
        )
        out.append(new.drop("far"))
        frontier = new.where(F.col("far") == size).drop("far")
        if is_empty(frontier):
            frontier = None
    return out


def _cycles(rest: DataFrame, group: list[str]) -> DataFrame:
    """Name the circle of every row that no root reaches by its smallest id.

    Pointer doubling: after k rounds ``jump`` is the ancestor 2**k steps up and ``least``
    the smallest id on the way; once 2**k covers the largest group, ``jump`` is on the
    circle, and the smallest id of as many steps from there is the circle's.
    """
    largest = rest.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    at = rest.select(*group, "id", "parent_id", "name", F.col("parent_id").alias("jump"), F.col("id").alias("least"))
    if not largest:
        return at.select(*group, "id", "parent_id", "name", F.col("least").alias("cycle_id"))

    def step(t: DataFrame, least: Column) -> DataFrame:
        far = t.select(*group, "id", "jump", "least").alias("b")
        j = t.alias("a").join(far, _same("a", "b", group, ("jump", "id")))
        return j.select(
            *[f"a.{g}" for g in group], "a.id", "a.parent_id", "a.name", F.col("b.jump").alias("jump"), least.alias("least")
        )

    span = 1
    while span < largest:
        old, at = at, cut(step(at, F.least("a.least", "b.least")))
        drop(old)
        span *= 2
    at = step(at, F.col("b.least"))
    return at.select(*group, "id", "parent_id", "name", F.col("least").alias("cycle_id"))
