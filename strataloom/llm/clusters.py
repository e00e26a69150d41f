"""Clusters of mutually similar records by power-iteration spectral clustering.

The affinity of two distinct vectors is 1 where their cosine reaches the threshold; its
row-normalised form (each vector linked to itself) is applied to several pseudorandom
vectors at once. What the iteration settles on is constant within a cluster and differs
between clusters, so the columns embed each record. Rows that equal all their neighbours
have settled, and only the others are iterated on. k-means over the embedding starts from
the occupied cells of a fine grid and moves rows between the centroids of their
neighbours until none moves; its clusters are the result. An exact check looks for
affinities that join two of them, which happens only where the iteration was ended before
it settled, and unites those clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataloom.llm.similar import Hashing, _matrix, _units, groups, links, usable_vectors
from strataloom.operators.graph import components
from strataloom.runtime import cut, drop, is_empty


@dataclass
class Clusters:
    """labels: rid, label. members: profile, key, rid. links: a, b, cos. vectors: rid, vector
    besides others. Clusters of one distinct vector have a label too, but no link."""

    labels: DataFrame
    members: DataFrame
    links: DataFrame
    vectors: DataFrame


def spectral_labels(edges: DataFrame, columns: int = 4, rounds: int = 5, settled: float = 1e-9) -> DataFrame:
    """(rid, label): the cluster of every node that has an edge; label is its smallest rid.

    edges: a, b (either order, no repeats). The iteration ends when no affinity joins two rows
    further apart than ``settled``, or after ``rounds``.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    start = lambda c: [F.xxhash64(c, F.lit(j)) / float(2**63) for j in range(columns)]
    names = [f"x{j}" for j in range(columns)]
    # the first step needs no join: the pseudorandom vectors are functions of the ids
    flow = both.groupBy("a").agg(F.count("*").alias("d"), *[F.sum(v).alias(n) for v, n in zip(start("b"), names, strict=True)])
    moving = cut(flow.select(F.col("a").alias("rid"), *[((F.col(n) + v) / (F.col("d") + 1)).alias(n) for v, n in zip(start("a"), names, strict=True)]))
    done: list[DataFrame] = []
    left = both
    for _ in range(rounds):
        now = reduce(DataFrame.unionByName, [*[d.select("rid", *names) for d in done], moving.select("rid", *names)])
        flow = left.join(now.withColumnRenamed("rid", "b"), "b").groupBy("a").agg(
            F.count("*").alias("d"),
            *[F.sum(n).alias(f"s{n}") for n in names], *[F.min(n).alias(f"lo{n}") for n in names], *[F.max(n).alias(f"hi{n}") for n in names],
        )
        apart = F.greatest(*[F.greatest(F.col(n), F.col(f"hi{n}")) - F.least(F.col(n), F.col(f"lo{n}")) for n in names])
        new = moving.join(flow, moving.rid == flow.a).select("rid", *[((F.col(n) + F.col(f"s{n}")) / (F.col("d") + 1)).alias(n) for n in names], apart.alias("apart"))
        new = cut(new)
        # a row that equals all its neighbours has settled; the others go on
        done.append(new.where(F.col("apart") <= settled))
        moving = new.where(F.col("apart") > settled)
        if is_empty(moving):
            break
        rest = cut(left.join(moving.select(F.col("rid").alias("a")), "a", "left_semi"))
        drop(left)  # only if it is a table of ``cut``
        left = rest
    x = reduce(DataFrame.unionByName, [d.select("rid", *names) for d in [*done, moving]])
    return _kmeans(x, both, names)


def _kmeans(x: DataFrame, both: DataFrame, names: list[str], most: int = 20) -> DataFrame:
    """k-means from the occupied grid cells, and the exact check."""
    cell = F.xxhash64(*[F.round(F.col(n), 6) + 0.0 for n in names])
    seeds = x.groupBy(cell.alias("cell")).agg(F.min("rid").alias("label"))
    at = cut(x.withColumn("cell", cell).join(seeds, "cell").select("rid", "label", *names))
    first = at
    for _ in range(most):
        labels = at.select("rid", "label")
        to = both.join(labels.select(F.col("rid").alias("b"), F.col("label").alias("other")), "b").join(labels.select(F.col("rid").alias("a"), "label"), "a")
        crossed = cut(to.where("label <> other").select("a", "label", "other").distinct())
        if is_empty(crossed):
            drop(crossed)
            return labels  # every affinity lies within one centroid's records
        centre = at.groupBy("label").agg(*[F.avg(n).alias(f"c{n}") for n in names])
        rivals = crossed.select(F.col("a").alias("rid"), F.col("other").alias("label")).join(at.drop("label"), "rid").unionByName(at.join(crossed.select(F.col("a").alias("rid")).distinct(), "rid", "left_semi"))
        far = sum((F.col(n) - F.col(f"c{n}")) * (F.col(n) - F.col(f"c{n}")) for n in names)
        best = rivals.join(centre, "label").groupBy("rid").agg(F.min(F.struct(far.alias("far"), "label")).alias("m")).select("rid", F.col("m.label").alias("to"))
        new = cut(at.join(best, "rid", "left").select("rid", F.coalesce("to", "label").alias("label"), *names, (F.col("to") != F.col("label")).alias("moved")))
        moved = not is_empty(new.where("moved"))
        if at is not first:
            drop(at)
        at = new
        if not moved:
            break
        drop(crossed)
    # exact check: clusters that an affinity joins are one; there are far fewer of them than of records
    labels = at.select("rid", "label")
    to = both.join(labels.select(F.col("rid").alias("b"), F.col("label").alias("other")), "b").join(labels.select(F.col("rid").alias("a"), "label"), "a")
    joined = components(to.where("label < other").select(F.col("label").alias("a"), F.col("other").alias("b")).distinct())
    labels = labels.join(joined, labels.label == joined.id, "left").select("rid", F.coalesce("component", "label").alias("label"))
    least = labels.groupBy("label").agg(F.min("rid").alias("least"))
    return cut(labels.join(least, "label").select("rid", F.col("least").alias("label")))


def similarity_clusters(df: DataFrame, key: str, vector: str, profile: str, min_cos: float = 0.9, how: Hashing = Hashing()) -> Clusters:
    """Cluster the usable vectors of ``df`` (see ``usable_vectors`` for what is left out)."""
    members, vectors = groups(usable_vectors(df, key, vector, profile))
    near = links(vectors, min_cos, how)
    labels = spectral_labels(near)
    alone = vectors.select("rid").join(labels, "rid", "left_anti").select("rid", F.col("rid").alias("label"))
    return Clusters(labels.unionByName(alone), members, near, vectors)


def unit_clusters(units: DataFrame, vectors: DataFrame, min_cos: float = 0.9, how: Hashing = Hashing()) -> tuple[DataFrame, Clusters]:
    """(unit_id, cluster_id, rid) of the units that share a cluster with another unit.

    units: unit_id, embedding_key; vectors: embedding_key, profile_key, vector. cluster_id
    is the smallest unit_id of the cluster. Repeated rows count once; a unit with several
    keys joins their clusters only under its smallest key. Units with a null id or without
    a usable vector are in no cluster.
    """
    units = units.where(F.col("unit_id").isNotNull()).groupBy("unit_id").agg(F.min("embedding_key").alias("key"))
    used = vectors.join(units.select(F.col("key").alias("embedding_key")).distinct(), "embedding_key", "left_semi").select("embedding_key", "profile_key", "vector")
    c = similarity_clusters(used, "embedding_key", "vector", "profile_key", min_cos, how)
    at = units.join(c.members.select("key", "rid"), "key").join(c.labels, "rid").select("unit_id", "rid", "label")
    at = cut(at)
    size = at.groupBy("label").agg(F.min("unit_id").alias("cluster_id"), F.count("*").alias("size")).where("size > 1")
    return at.join(size, "label").select("unit_id", "cluster_id", "rid", "size"), c


def describe(at: DataFrame, c: Clusters, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical): the members with the largest internal affinity, ties to the smaller id.

    A member's affinity is the sum of its cosines to all others of the cluster; equal vectors
    count 1. It is the product of its unit vector with the sum of the cluster's, less itself.
    """
    w = at.groupBy("rid", "cluster_id").agg(F.count("*").alias("n"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's sum of the unit vectors of every cluster in it."""
        for b in batches:
            ids, n, dim = (b.column(i).to_numpy() for i in (0, 1, 2))
            for d in np.unique(dim).tolist():
                here = np.flatnonzero(dim == d)
                u = _units(_matrix(b.column(3).take(pa.array(here)), d).astype(np.float64)) * n[here, None]
                own, to = np.unique(ids[here], return_inverse=True)
                total = np.zeros((len(own), d))
                np.add.at(total, to, u)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["cluster_id", "u"])

    def pulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(1).to_numpy()
            for d in np.unique(dim).tolist():
                t = b.take(pa.array(np.flatnonzero(dim == d)))
                u = _units(_matrix(t.column(2), d).astype(np.float64))
                total = t.column(3).flatten().to_numpy().reshape(len(u), d)
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(np.einsum("ij,ij->i", u, total) - 1)], names=["rid", "affinity"])

    unit = w.join(c.vectors.select("rid", "dim", "vector"), "rid")
    part = unit.select("cluster_id", "n", "dim", "vector").mapInArrow(sums, "cluster_id long, u array<double>")
    part = part.select("cluster_id", F.posexplode("u").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"))
    total = part.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("total"))
    rank = unit.join(total, "cluster_id").select("rid", "dim", "vector", "total").mapInArrow(pulls, "rid long, affinity double")
    first = Window.partitionBy("cluster_id").orderBy(F.desc(F.round("affinity", 6)), "unit_id")
    top = at.join(rank, "rid").withColumn("k", F.row_number().over(first)).where(F.col("k") <= typical)
    return top.groupBy("cluster_id").agg(
        F.first("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("k", "unit_id"))), lambda x: x.unit_id).alias("typical")
    )
