"""The search pipeline: selection, channels, merging, order, limits and reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom import runtime
from strataloom.functions import text as X
from strataloom.operators import knn

LIMIT = 4096  # results of a search where no limit is named
RERANK_CAP = 100  # candidates that a generative reranker is given at most
# The channels of a search.
CHANNELS = ("code", "docs", "config", "markup", "descriptions", "symbols")
# Kinds of declarations by the name they are asked for.
KINDS = {
    "function": ["function", "generator"], "method": ["method", "constructor"], "callable": ["function", "method", "constructor", "generator"],
    "class": ["class", "struct"], "type": ["class", "struct", "enum", "union", "type", "interface", "trait"], "interface": ["interface", "trait"],
    "field": ["field", "property"], "constant": ["constant", "variable"], "module": ["module", "namespace", "package"], "heading": ["heading"], "item": ["item", "key"], "rule": ["rule"],
}


def resolved_limit(asked: str | int | None = None, configured: str | int | None = None) -> int | None:
    """What was asked, else what is configured, else ``LIMIT``; "none" and "off" are no limit. Zero and less are errors."""
    for value in (asked, configured):
        if value is None:
            continue
        if str(value).strip().lower() in ("none", "off"):
            return None
        n = int(value)
        if n <= 0:
            raise ValueError("a limit is at least 1")
        return n
    return LIMIT


def channel_plan(**wanted: bool) -> list[str]:
    """The channels that a search looks at: those named, or all where none is."""
    unknown = set(wanted) - set(CHANNELS)
    if unknown:
        raise ValueError(f"unknown channels: {sorted(unknown)}")
    named = [c for c in CHANNELS if wanted.get(c)]
    return named or [c for c in CHANNELS if wanted.get(c) is not False]


def format_groups(wanted: Sequence[str] | None, default: Sequence[str] = ("code", "docs")) -> list[str]:
    """The format groups asked for, which replace the default; "all" is every group. None at all and unknown ones are errors."""
    if wanted is None:
        return list(default)
    asked = [w.strip().lower() for w in wanted if w.strip()]
    if not asked:
        raise ValueError("no format group is named")
    unknown = set(asked) - set(X.GROUPS) - {"all"}
    if unknown:
        raise ValueError(f"unknown format groups: {sorted(unknown)}; there are {', '.join(X.GROUPS)} and all")
    return list(X.GROUPS) if "all" in asked else [g for g in X.GROUPS if g in asked]


def kinds(names: Sequence[str]) -> list[str]:
    """Kinds behind the names asked for; a name that is no group stands for itself."""
    return sorted({k for n in names for k in KINDS.get(n.lower(), [n.lower()])})


@dataclass(frozen=True)
class Selection:
    """What a command looks at. All options are checked when the selection is made.

    paths: ordered globs. patterns: unanchored regular expressions, any of which may match.
    semantic: names whose meaning matched (from ``semantic_names``); null where no semantic
    selector was given, and an empty table matches nothing.
    """

    paths: Sequence[str] = ()
    patterns: Sequence[str] = ()
    ignore_case: bool = False
    kinds: Sequence[str] = ()
    groups: Sequence[str] | None = None
    under: str = ""
    semantic: DataFrame | None = None
    _regex: str | None = field(default=None, init=False)

    def __post_init__(self) -> None:
        for p in self.patterns:
            if any(x in p for x in ("(?=", "(?!", "(?<=", "(?<!")) or __import__("re").search(r"\\[1-9]", p):
                raise ValueError(f"look-around and back references are not allowed: {p}")
            __import__("re").compile(p)
        format_groups(self.groups)
        joined = "|".join(f"(?:{p})" for p in self.patterns)
        object.__setattr__(self, "_regex", ("(?i)" if self.ignore_case else "") + joined if joined else None)

    def files(self, path: Column) -> Column:
        """Whether a file takes part: folder, globs and format groups."""
        keep = X.under(path, self.under) & X.ordered_globs(path, list(self.paths))
        if self.groups is not None:
            keep &= X.format_group(path).isin(format_groups(self.groups))
        return F.coalesce(keep, F.lit(False))

    def named(self, *names: Column, aliases: Column | None = None, source: Column | None = None) -> Column:
        """Whether a pattern matches one of the names, aliases or the source; all match without patterns."""
        if self._regex is None:
            return F.lit(True)
        hits = [F.coalesce(n.rlike(self._regex), F.lit(False)) for n in (*names, *([source] if source is not None else []))]
        if aliases is not None:
            hits.append(F.coalesce(F.exists(aliases, lambda a: a.rlike(self._regex)), F.lit(False)))
        out = hits[0]
        for h in hits[1:]:
            out = out | h
        return out

    def kind(self, kind: Column) -> Column:
        return kind.isin(kinds(self.kinds)) if self.kinds else F.lit(True)

    def apply(self, df: DataFrame, regex: Column, words: str) -> DataFrame:
        """Rows of ``df`` by both families of selectors: neither given keeps all, one decides alone, both are joined by OR.

        regex: the column of ``named``; words: the column that semantic names are matched on.
        """
        if self.semantic is None:
            return df.where(regex) if self._regex is not None else df
        meant = df.join(self.semantic.select(F.col("words").alias("_w")).distinct(), F.col(words) == F.col("_w"), "left_semi")
        if self._regex is None:
            return meant
        kept = df.join(self.semantic.select(F.col("words").alias("_w"), F.lit(True).alias("_hit")).distinct(), F.col(words) == F.col("_w"), "left")
        return kept.where(regex | F.col("_hit").isNotNull()).drop("_w", "_hit")


def semantic_names(queries: DataFrame, names: DataFrame, low: float = 0.5) -> DataFrame:
    """(words, score): distinct names (words, vector) whose best cosine to a query reaches ``low``."""
    found = knn.nearest(queries, names.select(F.col("words").alias("id"), "vector"), None, low)
    return found.groupBy(F.col("id").alias("words")).agg(F.max("score").alias("score"))


def unit_hits(queries: DataFrame, units: DataFrame, vectors: DataFrame, low: float = 0.3, high: float = 2.0) -> DataFrame:
    """(query_id, unit_id, channel, score): units whose best channel scores in [low, high) for a query.

    units: unit_id, channel, key; vectors: key, vector, one row a key. Each distinct vector is scored once
    and its score goes out to all units that share it; a unit hit through several channels keeps
    the best score, and of equal ones the first channel by name.
    """
    found = knn.nearest(queries, vectors.select(F.col("key").alias("id"), "vector"), None, low, high)
    out = found.join(units.select("unit_id", "channel", "key"), found.id == units.key)
    best = F.min(F.struct((-F.round("score", 6)).alias("away"), "channel"))
    return out.groupBy("query_id", "unit_id").agg(best.alias("b")).select("query_id", "unit_id", F.col("b.channel").alias("channel"), (-F.col("b.away")).alias("score"))


def merged_hits(queries: DataFrame, units: DataFrame, vectors: DataFrame, low: float = 0.3) -> DataFrame:
    """``merged(unit_hits(...), ["unit_id"], ["query_id"])``, of which only the best hit of each vector and query block is ever formed.

    A unit's first query among its best ones is the first one of a vector that scores as much.
    """
    found = knn.best_query(queries, vectors.select(F.col("key").alias("id"), "vector"), low)
    out = found.join(units.select("unit_id", "channel", F.col("key").alias("id")), "id")
    best = F.min(F.struct((-F.col("score")).alias("away"), "query_id", "channel"))
    return out.groupBy("unit_id").agg(best.alias("b")).select("b.query_id", "unit_id", "b.channel", (-F.col("b.away")).alias("score"))


def _keyed(units: DataFrame, vectors: DataFrame) -> DataFrame:
    return units.select("unit_id", "channel", "key").join(vectors.select("key", "vector"), "key").withColumnRenamed("key", "id")


def top_hits(queries: DataFrame, units: DataFrame, vectors: DataFrame, limit: int, low: float = 0.3) -> DataFrame:
    """Those of ``unit_hits`` that ``limited(..., ["unit_id"], limit, ["query_id"])`` looks at."""
    return knn.top_units(queries, _keyed(units, vectors), limit + 1, low)


def channel_hits(queries: DataFrame, units: DataFrame, vectors: DataFrame, channel: str, low: float = 0.3) -> DataFrame:
    """(unit_id, score): the best score of each unit that has an id among its ``unit_hits`` through ``channel``."""
    there = units.where(F.col("channel") == channel).select("unit_id").distinct()
    return knn.best_in_channel(queries, _keyed(units.join(there, "unit_id", "left_semi"), vectors), channel, low)


def merged(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Hits of several queries as one list: of each identity the row of the best score, ties by ``order``."""
    first = Window.partitionBy(*keys).orderBy(F.desc("score"), *order)
    return hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def limited(hits: DataFrame, order: list[str], limit: int | None, by: list[str] | None = None) -> DataFrame:
    """The first ``limit`` hits by score and ``order`` with ``rank`` and ``omitted``: whether any were left out.

    ``limit`` + 1 rows are looked at, for each value of ``by`` or in all.
    """
    if by:
        w = Window.partitionBy(*by)
        ranked = hits.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), *order)))
        ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit + 1)
        out = ranked.withColumn("omitted", F.max("rank").over(w) > (limit if limit is not None else 1 << 62))
        return out if limit is None else out.where(F.col("rank") <= limit)
    some = hits.orderBy(F.desc("score"), *order)
    some = some if limit is None else some.limit(limit + 1)
    ranked = some.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *order)))  # at most limit + 1 rows
    out = ranked.withColumn("omitted", F.lit(False) if limit is None else F.max("rank").over(Window.partitionBy()) > limit)
    return out if limit is None else out.where(F.col("rank") <= limit)


def ranks(rows: DataFrame, name: str, order: list, parts: int | None = None) -> DataFrame:
    """``rows`` with their places in a total ``order`` from 1 on; ranges of rows are sorted in parallel, and only their sizes reach the driver."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = runtime.cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dict(placed.groupBy("_part").count().collect())  # one row a range
    before, sums = 0, []
    for part in sorted(sizes):
        sums.append((part, before))
        before += sizes[part]
    start = rows.sparkSession.createDataFrame(sums, "_part int, _before long")
    at = placed.join(F.broadcast(start), "_part")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return at.withColumn(name, rank.cast("int")).drop("_part", "_before")


def symbol_hits(names: DataFrame, scores: DataFrame, low: float, high: float = 2.0) -> DataFrame:
    """Symbols with the best score among their name and aliases, in [low, high).

    names: one row a symbol with ``spellings``, an array of normalised names; scores: words, score, one row a name.
    """
    keys = [c for c in names.columns if c != "spellings"]
    each = names.select(*keys, F.explode(F.array_distinct("spellings")).alias("words")).join(scores, "words")
    out = each.groupBy(*keys).agg(F.max("score").alias("score"))
    return out.where((F.col("score") >= low) & (F.col("score") < high))


def rerank_budget(limit: int | None, native: bool) -> int:
    """How many candidates a reranker gets: five times the limit, or at most ``RERANK_CAP`` where texts are generated."""
    n = limit or RERANK_CAP
    return 5 * n if native else min(RERANK_CAP, max(n, 1))


def reranked(hits: DataFrame, query: str, text: str, rerank: Callable[[str, list[str]], list[tuple[int, float]]], order: list[str], limit: int | None, native: bool = True) -> DataFrame:
    """The best hits in the order of ``rerank(query, texts) -> [(index, score)]``, ties by index.

    Only the budget of candidates reaches the driver. Every candidate must come back exactly once.
    """
    spark = hits.sparkSession
    top = limited(hits, order, rerank_budget(limit, native)).drop("omitted")
    rows = top.select("rank", text).orderBy("rank").collect()  # at most the budget
    scores = rerank(query, [r[text] or "" for r in rows])
    if sorted(i for i, _ in scores) != list(range(len(rows))):
        raise ValueError("every candidate must be ranked exactly once")
    got = spark.createDataFrame([(rows[i]["rank"], float(s)) for i, s in scores], "rank int, rerank_score double")
    out = top.join(F.broadcast(got), "rank").withColumnsRenamed({"score": "similarity", "rank": "index"})
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("rerank_score"), "index")))  # at most the budget
    return out if limit is None else out.where(F.col("rank") <= limit)


def by_file(hits: DataFrame, file: list[str]) -> DataFrame:
    """(file, best, n_hits): files in the order of their best hit, then by path."""
    out = hits.groupBy(*file).agg(F.max("score").alias("best"), F.count("*").alias("n_hits"))
    return out.orderBy(F.desc("best"), *file)


def excluded_hashes(selectors: DataFrame, units: DataFrame) -> DataFrame:
    """(source_hash) of what ``<file>:<symbol>`` selectors (repo, path, symbol) name.

    A qualified name that matches wins; else all units of that bare name. units: repo, path,
    name, qualified_name, source_hash.
    """
    both = selectors.alias("s").join(units.alias("u"), (F.col("s.repo") == F.col("u.repo")) & (F.col("s.path") == F.col("u.path")) & ((F.col("u.qualified_name") == F.col("s.symbol")) | (F.col("u.name") == F.col("s.symbol"))))
    both = both.select("s.repo", "s.path", "s.symbol", F.coalesce(F.col("u.qualified_name") == F.col("s.symbol"), F.lit(False)).alias("exact"), F.lower("u.source_hash").alias("source_hash"))
    best = both.groupBy("repo", "path", "symbol").agg(F.max("exact").alias("best"))
    return both.join(best, ["repo", "path", "symbol"]).where(F.col("exact") == F.col("best")).select("source_hash").distinct()
