"""Filling containers of fixed capacity by bulk-synchronous best fit.

Items and gaps are range-sorted by size, and items of one size are alike, as are gaps. A
round takes one size, largest first, with all its items at once: each item goes to the
smallest gap that holds it (the successor of its size among the gaps), items that want the
same gaps are told apart by their rank, and the gaps are updated for the next round. As
sizes and gaps are whole numbers up to the capacity, the sweep needs only how many items
there are of each size, so its input is bounded by the capacity and not by the documents;
the ranks are formed and the placements looked up in parallel over all items.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.runtime import cut

MAX_CAPACITY = 1 << 22  # bounds the driver's table of sizes (two numbers each)
_FEW_PLACES = 1 << 18  # placements up to which they are broadcast (some 10 MB), else joined


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (size, first rank, ranks, first container, items a container) and how many containers there are.

    Best fit decreasing over sizes with counts: an item goes to the smallest gap that holds
    it; equal gaps are used in the order of their containers.
    """
    gaps: list[tuple[int, int, int]] = []  # (gap, first container, containers), sorted
    out: list[tuple[int, int, int, int, int]] = []
    made = 0
    for size in sorted((s for s in counts if 0 < s <= capacity), reverse=True):
        left, rank = counts[size], 0
        while left:
            i = bisect_left(gaps, (size, -1, -1))
            if i == len(gaps):
                each = capacity // size
                new = -(-left // each)
                insort(gaps, (capacity, made, new))
                made += new
                continue
            gap, first, n = gaps.pop(i)
            each = gap // size
            full = min(n, left // each)
            if full:
                out.append((size, rank, full * each, first, each))
                rank, left = rank + full * each, left - full * each
                if gap - each * size:
                    insort(gaps, (gap - each * size, first, full))
                first, n = first + full, n - full
            if n and left and left < each:
                out.append((size, rank, left, first, left))
                if gap - left * size:
                    insort(gaps, (gap - left * size, first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                insort(gaps, (gap, first, n))
    return out, made


def ranked(df: DataFrame, by: str, order: list[str], parts: int = 1024) -> DataFrame:
    """``df`` (written once) with ``rank``: 0, 1, ... among the rows of the same ``by``.

    Rows are ranked within (``by``, spread) by hash of the first of ``order`` and offset by the counts of
    the smaller spreads, so no value of ``by`` meets in one task. Ranks depend on the rows alone,
    but for rows that are alike in all of ``order``, which are told apart arbitrarily.
    """
    df = cut(df.withColumn("_part", F.pmod(F.xxhash64(order[0]), F.lit(parts)).cast("int")))
    n = df.groupBy(by, "_part").count()
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    local = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1
    at = df.withColumn("_local", local).join(n, (F.col(by) == F.col("_by")) & (F.col("_part") == F.col("_p")))
    return at.withColumn("rank", F.col("_first") + F.col("_local")).drop("_part", "_p", "_by", "_first", "_local")


def fill_containers(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n_tokens, offset, container): where each item, or each piece of an oversized one, lies.

    items: a key and a size. Only an item larger than ``capacity`` is divided: into full
    containers and a rest, which is placed like any item; ``offset`` is where the piece
    starts in its item. Every row is an item of its own, also with a repeated or null key.
    Items of size 0 and of null size take no room: their container is null. No container
    holds more than ``capacity``.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    whole = cut(items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")))
    none = whole.where("n IS NULL OR n <= 0").select("key", F.lit(0).alias("piece"), F.coalesce("n", F.lit(0)).alias("n_tokens"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("long").alias("container"))
    some = whole.where("n > 0")
    cap = F.lit(capacity)
    fulls = F.floor(F.col("n") / cap)
    rest = some.where(F.col("n") % cap > 0).select("key", fulls.cast("int").alias("piece"), (F.col("n") % cap).alias("size"), (fulls * cap).alias("offset"))
    full = some.where(F.col("n") >= cap).select("key", F.explode(F.sequence(F.lit(0), (fulls - 1).cast("int"))).alias("piece"))
    # full pieces need no place to be found; their containers are numbered after the others
    full = ranked(full.withColumn("one", F.lit(1)), "one", ["key", "piece"])
    rest = ranked(rest, "size", ["key", "piece", "offset"])
    counts = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}  # at most ``capacity`` rows
    plan, made = best_fit(counts, capacity)
    schema = "of long, first_rank long, ranks long, first_container long, each long"
    # a size splits few gaps: the table is bounded by the capacity, whatever the number of items
    places = items.sparkSession.createDataFrame(plan, schema)
    few = len(plan) <= _FEW_PLACES
    at = rest.join(F.broadcast(places) if few else places, (F.col("size") == F.col("of")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("ranks")))
    container = F.col("first_container") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))
    placed = at.select("key", "piece", F.col("size").alias("n_tokens"), "offset", container.alias("container"))
    own = full.select("key", "piece", cap.cast("long").alias("n_tokens"), (F.col("piece") * cap).cast("long").alias("offset"), (F.lit(made) + F.col("rank")).alias("container"))
    return placed.unionByName(own).unionByName(none)
