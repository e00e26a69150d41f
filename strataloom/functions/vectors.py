"""Vector functions as Column expressions, and embedding providers run over Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision within [-1, 1]; 0 for a zero vector, another length or a null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    inner = F.coalesce(F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner))


def unit_length(v: Column, dim: int) -> Column:
    """The vector at length 1 as floats; null if it is not finite, all zero or of another dimension."""
    bound = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # noqa: E731  (evaluated once, not for each element)
    by_length = lambda u: bound(F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(u, lambda x: (x / n).cast("float")))
    top = F.array_max(F.transform(v, F.abs)).cast("double")
    out = bound(top, lambda t: bound(F.transform(v, lambda x: x.cast("double") / t), by_length))  # lengths down to the smallest numbers
    ok = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (top > 0)
    return F.when(ok, out)


class Vector(Protocol):
    """What an embedding provider offers: a profile's name, its dimensions, texts at once, and the vectors of texts."""

    profile: str
    dimensions: int
    batch_limit: int

    def embed(self, inputs: list[str], query: bool = False) -> np.ndarray: ...


class HashVector:
    """Words hashed to signed coordinates: needs no network and gives the same vectors everywhere."""

    def __init__(self, dimensions: int = 64, batch_limit: int = 512):
        self.profile, self.dimensions, self.batch_limit = f"words-{dimensions}", dimensions, batch_limit
        self._known: dict[str, tuple[int, int]] = {}

    def embed(self, inputs: list[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(inputs), self.dimensions))
        for row, text in zip(out, inputs, strict=True):
            for w in re.findall("[a-z0-9]+", text.lower()):
                if w not in self._known:
                    h = hashlib.md5(w.encode()).hexdigest()
                    self._known[w] = int(h[:4], 16) % self.dimensions, 1 if h[4] < "8" else -1
                at, sign = self._known[w]
                row[at] += sign
        return out


def embed_table(df: DataFrame, key: str, text: str, provider: Vector) -> DataFrame:
    """(key, vector) of every row with a text, embedded in batches of the provider's limit.

    Vectors that are not finite or all zero are left out, as are null texts; a provider that
    returns another number of vectors or another dimension fails the job.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), provider.batch_limit):
                part = texts[at : at + provider.batch_limit]
                x = np.asarray(provider.embed(part), np.float64)
                if x.shape != (len(part), provider.dimensions):
                    raise ValueError(f"{provider.profile} gave {x.shape} for {len(part)} texts")
                ok = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)).take(pa.array(ok)), pa.array(x[ok].tolist(), pa.list_(pa.float64()))], names=["key", "vector"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, vector array<double>")
