"""Most similar vectors for every vector, by multiprobe p-stable hashing.

Distinct vectors are hashed into bucket tables of p-stable functions. Every vector lies in
one bucket of a table and visits, besides it, the perturbed buckets in the order of their
estimated success: the distances to the borders of the hash cells are sorted, and
perturbation sets over these ranks are taken by the expected sum of squared distances.
Vectors that meet in a bucket become candidates if their random-hyperplane signatures
allow the wanted cosine; candidates are merged over the tables and ranked by exact cosine
in double precision.

The number of functions follows the logarithm of the number of vectors, so buckets stay
small at any size, and there are as many tables as a simulation of the same functions
needs to find the wanted share of pairs that lie at the least cosine itself; nearer pairs
are found more often. Work follows the number of distinct vectors, not of rows: equal
vectors form one group, and only a group's few smallest keys can be anyone's neighbours.
Buckets with more members than ``bucket_rows`` are not joined but compared block by block,
each vector keeping its best ``keep`` of a block and a spanning forest of all its links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.runtime import cut, drop, is_empty

_PROFILES_BROADCAST = 10_000


@dataclass(frozen=True)
class Hashing:
    recall: float = 0.9  # share of the pairs at the least cosine that the tables are sized for
    tables: int = 0  # 0: as many as that takes, but ``least_tables``
    least_tables: int = 5  # small collections are searched better than they must be, for clusters' sake
    width: int = 0  # functions of a table; 0: by the number of vectors
    probes: int = 7
    cells: float = 5.0  # cell width in distances of the least cosine wanted
    bucket_fill: float = 12.0  # unrelated vectors of a bucket that the width aims at
    at_once: int = 3  # tables hashed and joined at a time, each time freeing its shuffle files
    passes: int = 2  # reranking in so many parts, likewise
    seed: int = 20240229
    bucket_rows: int = 2048

    def sized(self, n: int, min_cos: float) -> Hashing:
        """With width and tables for ``n`` vectors."""
        near, far = math.sqrt(max(2 - 2 * min_cos, 0.02)), math.sqrt(2.0)
        width = self.width or max(2, math.ceil(math.log(max(n, 1) / self.bucket_fill + 1) / -math.log(_same_cell(far, self.cells * near))))
        tables = self.tables or max(self.least_tables, math.ceil(math.log(1 - self.recall) / math.log(1 - _found(width, self.probes, self.cells, near))))
        return replace(self, width=width, tables=tables)


def _same_cell(distance: float, cell: float) -> float:
    """The chance that one function puts two vectors of a distance into one cell."""
    r = cell / distance
    normal = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


@lru_cache(maxsize=64)
def _found(width: int, probes: int, cells: float, distance: float, trials: int = 20_000) -> float:
    """The simulated chance that one table finds a pair, from either side."""
    rng = np.random.default_rng(7)
    sets = _templates(width, probes)
    x = rng.uniform(0, cells, (trials, width))
    y = x + rng.normal(size=(trials, width))  # in units of the distance
    mul = rng.integers(1, 2**62, width) * 2 + 1
    got = np.zeros(trials, bool)
    for a, b in ((x, y), (y, x)):
        own = np.floor(b / cells).astype(np.int64)
        got |= (_visited(a / cells, mul, sets) == (own * mul).sum(1)[:, None]).any(1)
    return float(min(max(got.mean(), 1e-4), 0.9999))


def _visited(f: np.ndarray, mul: np.ndarray, sets: list[tuple[int, ...]]) -> np.ndarray:
    """Own and perturbed buckets of rows of function values, own one first."""
    with np.errstate(over="ignore"):
        width = f.shape[1]
        whole = np.floor(f)
        part = f - whole
        own = (whole.astype(np.int64) * mul).sum(1)
        out = [own]
        if sets:
            most = max(max(s) for s in sets)
            order = np.argsort(np.concatenate([part, 1 - part], axis=1), axis=1)[:, :most]
            step = np.where(order < width, -1, 1) * mul[order % width]
            for s in sets:
                out.append(own + sum(step[:, j - 1] for j in s))
        return np.stack(out, axis=1)


def usable_vectors(df: DataFrame, key: str, vector: str, profile: str) -> DataFrame:
    """(profile, key, dim, vector) of the rows that can be compared; vectors are bytes of floats.

    Left out are null keys, null vectors, vectors holding null, NaN or infinite numbers,
    all-zero vectors, and vectors of another dimension than most of their profile (of
    equally frequent dimensions the smaller). A null profile is a profile of its own.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float32)  # null numbers become NaN
            size = lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            ok = (size > 0) & (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            raw = x.tobytes()
            data = [raw[4 * (e - n) : 4 * e] if o else None for o, e, n in zip(ok.tolist(), ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int32()), pa.array(data, pa.binary())], names=["profile", "key", "dim", "vector"])

    rows = df.select(F.col(profile).alias("profile"), F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("key").isNotNull())
    sized = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(profile).alias("of"), F.size(vector).alias("dim")).where("dim > 0")
    dims = sized.groupBy("of", "dim").count().groupBy("of").agg(F.max(F.struct("count", (-F.col("dim")).alias("d"))).alias("m"))
    dims = cut(dims.select("of", (-F.col("m.d")).alias("most")))
    few = dims.limit(_PROFILES_BROADCAST + 1).count() <= _PROFILES_BROADCAST
    rows = rows.mapInArrow(run, f"profile {kinds[profile]}, key {kinds[key]}, dim int, vector binary").where("vector IS NOT NULL")
    return rows.join(F.broadcast(dims) if few else dims, F.col("profile").eqNullSafe(F.col("of")) & (F.col("dim") == F.col("most"))).select("profile", "key", "dim", "vector")


def groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: profile, key, rid) and (vectors: rid, profile, dim, vector, first_key), one per distinct vector.

    Vectors are told apart by 128 bits of hash; first_key is the smallest key of the group.
    A key with several vectors keeps the one with the smallest hash.
    """
    h = F.struct(F.xxhash64("profile", "vector").alias("x"), F.xxhash64(F.lit(7), "vector", "profile").alias("y"))
    rows = cut(rows.withColumn("h", h))
    vectors = rows.groupBy("profile", "h").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.min("key").alias("first_key"))
    vectors = cut(vectors.select(F.monotonically_increasing_id().alias("rid"), "profile", "h", "dim", "vector", "first_key"))
    members = rows.groupBy("profile", "key").agg(F.min("h").alias("h"))
    members = members.join(vectors.select("rid", F.col("h").alias("of")), F.col("h") == F.col("of")).select("profile", "key", "rid")
    members = cut(members)
    drop(rows)
    return members, vectors


def _templates(width: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets over ranks 1..2*width of border distances, likeliest first."""
    m, top = width, 2 * width
    e = [
        j * (j + 1) / (4 * (m + 1) * (m + 2))
        if j <= m
        else 1 - (top + 1 - j) / (m + 1) + (top + 1 - j) * (top + 2 - j) / (4 * (m + 1) * (m + 2))
        for j in range(1, top + 1)
    ]
    sets = [
        (sum(e[j - 1] for j in s), s)
        for r in (1, 2, 3)
        for s in itertools.combinations(range(1, top + 1), r)
        if not any(top + 1 - j in s for j in s)  # both sides of one cell
    ]
    return [s for _, s in sorted(sets)[:probes]]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column of floats."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), dim)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; lengths go down to the smallest floats, so rows are scaled before the norm."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hasher(how: Hashing, min_cos: float, tables: list[int], probe: bool):
    cell = how.cells * math.sqrt(max(2 - 2 * min_cos, 0.02))
    sets = _templates(how.width, how.probes) if probe else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for b in batches:
            rid, salt = b.column(0).to_numpy(), b.column(1).to_numpy()
            size = b.column(3).to_numpy()
            for d in np.unique(size).tolist():
                if d not in made:
                    draw = lambda k, d=d: np.random.default_rng([how.seed, d, k])
                    planes = draw(0).normal(size=(d, 128)).astype(np.float32)
                    funcs = [(g.normal(size=(d, how.width)).astype(np.float32), g.uniform(0, cell, how.width).astype(np.float32), g.integers(1, 2**62, how.width) * 2 + 1) for g in (draw(t + 1) for t in tables)]
                    made[d] = planes, funcs
                planes, funcs = made[d]
                here = np.flatnonzero(size == d)
                x = _units(_matrix(b.column(2).take(pa.array(here)), d))
                sig = np.packbits(x @ planes > 0, axis=1).view(np.int64)
                with np.errstate(over="ignore"):
                    k = np.concatenate([_visited((x @ f + shift) / cell, mul, sets) + (mul[0] * (t + 1) + salt[here])[:, None] for t, (f, shift, mul) in zip(tables, funcs, strict=True)], axis=1)
                n = k.shape[1]
                cols = [k.ravel(), *(np.repeat(c, n) for c in (rid[here], sig[:, 0], sig[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", "rid", "s", "t"])

    return run


def candidates(vectors: DataFrame, min_cos: float, how: Hashing, keep: int) -> DataFrame:
    """(a, b), a < b: pairs of vectors that meet in a bucket and may reach ``min_cos``.

    how: with its sizes set. A bucket over ``bucket_rows`` gives each vector that visits it
    its best ``keep`` of each block, and a spanning forest of its links.
    """
    src = vectors.select("rid", F.xxhash64("profile").alias("salt"), "vector", "dim")
    kind = "bucket long, rid long, s long, t long"
    away = math.acos(max(-1.0, min(1.0, min_cos))) / math.pi
    bits = min(128, math.ceil(128 * away + 3.5 * math.sqrt(128 * away * (1 - away))))  # 1 in 4,000 beyond
    parts = []
    for first in range(0, how.tables, how.at_once):
        tables = list(range(first, min(how.tables, first + how.at_once)))
        index = src.mapInArrow(_hasher(how, min_cos, tables, False), kind)
        probe = src.mapInArrow(_hasher(how, min_cos, tables, True), kind)
        full = cut(index.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > how.bucket_rows))
        dense = not is_empty(full)
        few = full.limit(_PROFILES_BROADCAST + 1).count() <= _PROFILES_BROADCAST if dense else False
        wide = F.broadcast(full.select("bucket")) if few else full.select("bucket")
        i, p = (t.join(wide, "bucket", "left_anti") if dense else t for t in (index, probe))
        differ = F.bit_count(F.col("i.s").bitwiseXOR(F.col("p.s"))) + F.bit_count(F.col("i.t").bitwiseXOR(F.col("p.t")))
        met = p.alias("p").join(i.hint("shuffle_hash").alias("i"), "bucket").where((F.col("i.rid") != F.col("p.rid")) & (differ <= bits))
        pairs = met.select(F.least("i.rid", "p.rid").alias("a"), F.greatest("i.rid", "p.rid").alias("b"))
        if dense:
            pairs = pairs.unionByName(_dense(index, probe, full, few, vectors, min_cos, how, keep))
        parts.append(cut(pairs.distinct()))
        drop(full)
    return parts[0] if len(parts) == 1 else _merged(parts)


def _merged(parts: list[DataFrame]) -> DataFrame:
    out = cut(reduce(DataFrame.unionByName, parts).distinct())
    drop(*parts)
    return out


def _dense(index, probe, full, few, vectors, min_cos, how, keep) -> DataFrame:
    """Candidates of the buckets over ``bucket_rows``, compared in blocks."""
    rows = how.bucket_rows
    seen = probe.join(F.broadcast(full) if few else full, "bucket")
    sizes = cut(seen.groupBy("bucket").agg(F.first("n").alias("n"), F.count("*").alias("m")))
    s = F.broadcast(sizes) if few else sizes
    ib, pb = F.ceil(F.col("n") / rows).cast("int"), F.ceil(F.col("m") / rows).cast("int")
    own = lambda blocks, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), blocks).cast("int")
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), blocks - 1))
    left = index.join(s, "bucket").select("bucket", "rid", own(ib, 1).alias("i"), spread(pb).alias("j"), F.lit(True).alias("stored"))
    right = probe.join(s, "bucket").select("bucket", "rid", spread(ib).alias("i"), own(pb, 2).alias("j"), F.lit(False).alias("stored"))
    both = left.unionByName(right).join(vectors.select("rid", "dim", "vector"), "rid")

    def best(t: pa.Table) -> pa.Table:
        stored = t.column("stored").to_numpy(zero_copy_only=False)
        rid, dim = t.column("rid").to_numpy(), t.column("dim").to_numpy()
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not stored.any() or stored.all() or (dim != dim[0]).any():
            return none  # two dimensions meet in a bucket by chance only
        x = _units(_matrix(t.column("vector"), int(dim[0])).astype(np.float64))
        a, b = rid[~stored], rid[stored]
        s = np.floor((x[~stored] @ x[stored].T) * 1e4 + 0.5) / 1e4
        s[a[:, None] == b[None, :]] = -2
        s[s < min_cos] = -2
        order = np.lexsort((np.broadcast_to(b, s.shape), -s), axis=1)[:, :keep]
        got = np.take_along_axis(s, order, 1) > -2
        # a spanning forest of all links keeps the block connected as its links do
        u, v = (np.concatenate(c) for c in zip((np.repeat(a, got.sum(1)), b[order[got]]), _forest(a, b, s > -2), strict=True))
        return pa.table({"a": np.minimum(u, v), "b": np.maximum(u, v)})

    return both.groupBy("bucket", "i", "j").applyInArrow(best, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the bipartite links, found breadth first."""
    us, vs = [], []
    free_a, free_b = linked.any(1), linked.any(0)
    while free_a.any():
        first = int(np.argmax(free_a))
        free_a[first] = False
        todo = [first]
        while todo:
            r = todo.pop()
            new = np.flatnonzero(linked[r] & free_b)
            free_b[new] = False
            us += [a[r]] * len(new)
            vs += list(b[new])
            for c in new:
                more = np.flatnonzero(linked[:, c] & free_a)
                free_a[more] = False
                us += list(a[more])
                vs += [b[c]] * len(more)
                todo += list(more)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        dim = b.column(4).to_numpy()
        for d in np.unique(dim).tolist():
            t = b.take(pa.array(np.flatnonzero(dim == d)))
            x, y = (_matrix(t.column(i), d).astype(np.float64) for i in (2, 3))
            dot = np.einsum("ij,ij->i", x, y)
            cos = dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(np.clip(cos, -1, 1))], names=["a", "b", "cos"])


def links(vectors: DataFrame, min_cos: float, how: Hashing = Hashing(), keep: int = 6) -> DataFrame:
    """(a, b, cos), a < b: candidates whose exact cosine, rounded to 4 decimals, reaches ``min_cos``."""
    how = how.sized(vectors.count(), min_cos)
    pairs = candidates(vectors, min_cos, how, keep)
    v = vectors.select("rid", "profile", "dim", "vector")
    out = []
    for k in range(how.passes):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(how.passes)) == k  # noqa: B023, E731
        at = pairs.where(mine("a")).join(v.where(mine("rid")), F.col("a") == F.col("rid"))
        at = at.select("a", "b", F.col("vector").alias("x"), F.col("profile").alias("p"), F.col("dim").alias("d"))
        at = at.join(v, (at.b == v.rid) & at.p.eqNullSafe(v.profile) & (at.d == v.dim))
        at = at.select("a", "b", "x", F.col("vector").alias("y"), "dim")
        out.append(cut(at.mapInArrow(_cosines, "a long, b long, cos double").where(F.round("cos", 4) >= min_cos)))
    drop(pairs)
    return reduce(DataFrame.unionByName, out)


def most_similar(
    df: DataFrame, key: str, vector: str, profile: str, k: int = 5, min_cos: float = 0.9, how: Hashing = Hashing()
) -> DataFrame:
    """(profile, key, neighbor, cos): for each usable vector its at most ``k`` nearest others.

    Nearest by cosine rounded to 4 decimals, ties to the smaller key; only cosines of at
    least ``min_cos``, and only within a profile. Repeated rows of a key count once; equal
    vectors under different keys are each other's neighbours at 1.0. See
    ``usable_vectors`` for what is left out; an empty table gives an empty result. Other
    columns are ignored.
    """
    members, vectors = groups(usable_vectors(df, key, vector, profile))
    near = links(vectors, min_cos, how, k + 1)
    cos = F.round("cos", 4).alias("cos")
    both = near.select("a", "b", cos).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), cos))
    both = both.join(vectors.select(F.col("rid").alias("b"), "first_key"), "b")
    nearest = Window.partitionBy("a").orderBy(F.desc("cos"), "first_key")
    both = both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= k + 1)
    # groups of several keys, of which the smallest k + 1 can be neighbours
    several = members.groupBy("rid").agg(F.count("*").alias("size")).where("size > 1").select("rid")
    few = Window.partitionBy("rid").orderBy("key")
    more = members.join(several, "rid", "left_semi").withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    more = cut(more.select(F.col("rid").alias("b"), "key"))
    both = both.select("a", "b", "cos").unionByName(several.select(F.col("rid").alias("a"), F.col("rid").alias("b"), F.lit(1.0).alias("cos")))
    single = vectors.select(F.col("rid").alias("b"), F.col("first_key").alias("key")).join(more.select("b").distinct(), "b", "left_anti")
    named = both.join(single.unionByName(more), "b").groupBy("a").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("away"), F.col("key").alias("neighbor")))), 1, k + 1).alias("near")
    )  # at most (k + 2) * (k + 1) entries each
    at = members.join(named, members.rid == named.a).select("profile", "key", F.filter("near", lambda x: x.neighbor != F.col("key")).alias("near"))
    at = at.select("profile", "key", F.explode(F.slice("near", 1, k)).alias("x"))
    return at.select("profile", "key", F.col("x.neighbor").alias("neighbor"), (-F.col("x.away")).alias("cos"))
