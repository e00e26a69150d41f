"""How much of a text has stayed since an earlier version."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def retained_lines(old: str, new: str) -> tuple[int, int]:
    """(lines that stay in order, lines of the longer version): the longest common subsequence of lines.

    Common ends are cut off; the rest is swept row by row with one bit a line of the other side, so the
    memory is linear and a step handles all lines of a row at once.
    """
    a, b = old.splitlines(), new.splitlines()
    most = max(len(a), len(b))
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & whole
    return lo + hi + len(a) - row.bit_count(), most


def relocated(old: list[str], new: list[str], start: int, end: int) -> tuple[int, int] | None:
    """Where the lines ``start`` to ``end`` (from 1, inclusive) of ``old`` stand in ``new``: unchanged at one other place, else
    where the lines around them that stayed say; null where nothing of them is left."""
    part = old[start - 1 : end]
    if not part:
        return None
    at = [i for i in range(len(new) - len(part) + 1) if new[i] == part[0] and new[i : i + len(part)] == part]
    if len(at) == 1:
        return at[0] + 1, at[0] + len(part)
    kept: dict[int, int] = {}
    for m in difflib.SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks():
        kept.update({m.a + k: m.b + k for k in range(m.size)})
    inside = [kept[i] for i in range(start - 1, end) if i in kept]
    return (min(inside) + 1, max(inside) + 1) if inside else None


def freshness(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, same, lines, ratio): lines kept from ``old`` to ``new``.

    A null version counts as an empty text; two empty texts are wholly fresh (ratio 1).
    """
    kind = T.StructType([T.StructField("same", T.LongType()), T.StructField("lines", T.LongType())])

    @F.pandas_udf(kind)
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame([retained_lines(x, y) for x, y in zip(a, b, strict=True)], columns=["same", "lines"])

    at = pairs.select(*keys, count(F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))).alias("c")).select(*keys, "c.same", "c.lines")
    return at.withColumn("ratio", F.when(F.col("lines") == 0, 1.0).otherwise(F.col("same") / F.col("lines")))
