"""Mixing sources to target shares of all tokens.

The texts of each source, in pseudorandom order, form one run of tokens that is cut into
blocks of fixed length. Each output shard draws how many of its slots go to each source:
the shards are halved again and again, and each half draws its multinomial share of what
its parent has, so every shard finds its own counts without the others'. The slots of a
source are numbered through, mapped through a pseudorandom permutation of its block
indices for every repeat, and joined to the blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.runtime import cut

_MAX_SOURCES = 10_000


@dataclass
class Mixture:
    """selection: shard, slot, source, block, repeat, key, from_token, n_tokens (one row for each
    piece of a text in a slot). shares: source, target_share, reached_share, n_tokens, uses (the
    most repeats of any of its blocks), max_repeats, available_tokens."""

    selection: DataFrame
    shares: DataFrame


def _runs(sized: DataFrame, parts: int) -> DataFrame:
    """Each text with the place where it starts in its source's run of tokens; no source meets in one task."""
    sized = cut(sized.withColumn("part", F.pmod(F.xxhash64("row", F.lit(11)), F.lit(parts)).cast("int")))
    total = sized.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "part").orderBy(F.xxhash64("row", F.lit(13)), "row").rowsBetween(Window.unboundedPreceding, -1)
    at = sized.withColumn("local", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    at = at.join(total, (at.source == total.s) & (at.part == total.p))
    return at.select("source", "key", "n", (F.col("base") + F.col("local")).alias("start"))


def _halve(have: np.ndarray, room: int, rng: np.random.Generator) -> np.ndarray:
    """A multinomial draw of ``room`` slots from what each source has, brought within what it has."""
    total = int(have.sum())
    draw = rng.multinomial(room, have / total) if total else np.zeros_like(have)
    low = np.maximum(0, have - (total - room))  # the other half has no room for more
    draw = np.clip(draw, np.minimum(low, have), have)
    while (off := room - int(draw.sum())) != 0:
        free = have - draw if off > 0 else draw - low
        part = np.minimum(free, np.ceil(abs(off) * (free / free.sum())).astype(np.int64))
        over = np.maximum(np.cumsum(part) - abs(off), 0)
        part = np.maximum(part - np.diff(over, prepend=0), 0)
        draw = draw + part if off > 0 else draw - part
    return draw


def shard_counts(slots: np.ndarray, per: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, its own slots of each source) for shards from ``first`` to before ``last``."""
    n = int(slots.sum())

    def go(lo: int, hi: int, before: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, before, have
            return
        mid = (lo + hi) // 2
        left = _halve(have, min(n, mid * per) - lo * per, np.random.default_rng([seed, lo, hi]))
        yield from go(lo, mid, before, left)
        yield from go(mid, hi, before + left, have - left)

    yield from go(0, -(-n // per), np.zeros_like(slots), slots)


def permuted(i: np.ndarray, m: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..m-1 takes each i: a Feistel network of six rounds, walked until it ends below m."""
    half = max(1, ((m - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = [np.uint64(k) for k in np.random.default_rng([key, 5]).integers(0, 2**63, 6)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> shift, x & mask
        for k in keys:
            f = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        return a << shift | b

    x = once(i.astype(np.uint64))
    while (out := np.flatnonzero(x >= m)).size:
        x[out] = once(x[out])
    return x.astype(np.int64)


def mix_sources(
    sized: DataFrame,
    targets: DataFrame,
    key: str = "key",
    source: str = "source",
    size: str = "n_tokens",
    block: int = 64,
    slots_per_shard: int = 4096,
    total_tokens: int | None = None,
    seed: int = 17,
) -> Mixture:
    """Mix ``sized`` (key, source, size) to ``targets`` (source, target_share, max_repeats).

    Sources are compared in lower case and without outer blanks. Shares are divided by their
    sum over the sources that have tokens; a wanted source without any is reported with a
    reached share of 0. The total is the largest at which no source needs more than
    ``max_repeats`` of its blocks, or ``total_tokens`` if that is smaller. Texts of null, of
    other sources, of share 0, of no tokens or null sizes take no part. Repeated rows are
    texts of their own. An empty side gives an empty selection. Shares are met to one block
    a source; the last block of a source can be shorter.
    """
    spark = sized.sparkSession
    name = lambda c: F.lower(F.trim(F.col(c)))
    want = targets.groupBy(name("source").alias("source")).agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    want = want.where("source IS NOT NULL").limit(_MAX_SOURCES + 1).collect()
    if len(want) > _MAX_SOURCES:
        raise ValueError(f"more than {_MAX_SOURCES} sources in targets")
    use = [r.source for r in want if (r.share or 0) > 0 and (r.repeats or 0) > 0]
    rows = sized.select(F.col(key).alias("key"), name(source).alias("source"), F.col(size).cast("long").alias("n"), F.monotonically_increasing_id().alias("row"))
    rows = rows.where(F.col("source").isin(use) & (F.col("n") > 0)) if use else rows.limit(0)
    at = cut(_runs(rows, max(16, 4 * spark.sparkContext.defaultParallelism)))
    have = {r.source: r.n for r in at.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # at most as many as targets
    live = sorted(s for s in use if have.get(s))
    share = {r.source: float(r.share) for r in want if r.source in live}
    scale = sum(share.values())
    share = {s: x / scale for s, x in share.items()}
    repeats = {r.source: int(r.repeats) for r in want if r.source in live}
    blocks = {s: -(-have[s] // block) for s in live}
    total = min((blocks[s] * repeats[s] / share[s] for s in live), default=0)
    total = int(total if total_tokens is None else min(total, total_tokens / block))
    slots = {s: min(blocks[s] * repeats[s], round(total * share[s])) for s in live}
    n = sum(slots.values())
    per = slots_per_shard
    size_of, all_slots = [blocks[s] for s in live], np.array([slots[s] for s in live], np.int64)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shards = b.column(0).to_numpy()
            for shard, before, own in shard_counts(all_slots, per, int(shards[0]), int(shards[-1]) + 1, seed) if len(shards) else ():
                at_slot = 0
                for k in np.flatnonzero(own).tolist():
                    j = np.arange(before[k], before[k] + own[k])
                    repeat, i = np.divmod(j, size_of[k])
                    block_of = np.empty_like(i)
                    for r in np.unique(repeat).tolist():
                        block_of[repeat == r] = permuted(i[repeat == r], size_of[k], hash((seed, k, r)) & (2**63 - 1))
                    m = len(j)
                    cols = [pa.array(np.full(m, shard), pa.int64()), pa.array(at_slot + np.arange(m), pa.int64()), pa.array([live[k]] * m, pa.string()), pa.array(repeat, pa.int64()), pa.array(block_of, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["shard", "slot", "source", "repeat", "block"])
                    at_slot += m

    # contiguous ranges of shards: a task walks down to its own range once
    drawn = spark.range(-(-n // per) if n else 0).mapInArrow(draw, "shard long, slot long, source string, repeat long, block long")
    pieces = at.select("source", "key", "n", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("start"), F.col("block") * block)
    hi = F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * block)
    pieces = pieces.select("source", "block", "key", (lo - F.col("start")).alias("from_token"), (hi - lo).alias("n_tokens"))
    chosen = drawn.join(pieces, ["source", "block"]).select("shard", "slot", "source", "block", "repeat", "key", "from_token", "n_tokens")
    got = chosen.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), (F.max("repeat") + 1).alias("uses"))
    goal = spark.createDataFrame([(r.source, r.share, r.repeats, have.get(r.source, 0)) for r in want], "source string, target_share double, max_repeats int, available_tokens long")
    out = goal.join(got, "source", "left").na.fill(0, ["n_tokens", "uses"])
    everything = F.sum("n_tokens").over(Window.partitionBy())  # one row a source
    shares = out.select("source", "target_share", F.coalesce(F.col("n_tokens") / F.nullif(everything, F.lit(0)), F.lit(0.0)).alias("reached_share"), "n_tokens", "uses", "max_repeats", "available_tokens")
    return Mixture(chosen, shares)
