import numpy as np
import pytest

from strataloom.llm.clusters import describe, spectral_labels, unit_clusters
from strataloom.llm.similar import Hashing, most_similar

SCHEMA = "embedding_key string, vector array<float>, profile_key string, cos double"


def brute(rows, k=5, min_cos=0.9):
    use = {}
    for key, v, p, _ in rows:
        if key is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use[(p, key)] = np.array(v, np.float32).astype(float)
    out = set()
    for (p, a), x in use.items():
        near = [(-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 4), b) for (q, b), y in use.items() if q == p and b != a]
        out |= {(p, a, b) for c, b in sorted(near)[:k] if -c >= min_cos}
    return out


def made(n=300, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = rng.normal(size=16)
        for j in range(rng.integers(1, 8)):
            v = (base + rng.normal(size=16) * 0.08) * rng.uniform(0.2, 4)
            rows.append((f"k{i:04d}_{j}", v.tolist(), "a" if i % 3 else "b", 0.0))
    # equal vectors, repeats, unusable rows
    same = rng.normal(size=16).tolist()
    rows += [(f"z{j:02d}", same, "a", 0.0) for j in range(12)] + [("z00", same, "a", 1.0), ("y0", same, "b", 0.0)]
    rows += [("n0", None, "a", 0.0), ("n1", [0.0] * 16, "a", 0.0), ("n2", [float("nan")] * 16, "a", 0.0), ("n3", [1.0] * 8, "a", 0.0), ("n4", [], "a", 0.0)]
    rows += [("n5", [1.0] * 15 + [None], "a", 0.0), (None, same, "a", 0.0), ("p0", same, None, 0.0), ("tiny", [1e-38] * 16, "a", 0.0)]
    return rows


@pytest.mark.parametrize("how", [Hashing(), Hashing(bucket_rows=4)])
def test_recall(spark, how):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.profile, r.key, r.neighbor) for r in most_similar(df, "embedding_key", "vector", "profile_key", how=how).collect()}
    want = brute(rows)
    assert len(got & want) >= 0.97 * len(want)
    assert {(p, a) for p, a, _ in got} <= {(p, a) for p, a, _ in want}
    assert {b for p, a, b in got if a == "z05"} == {"z00", "z01", "z02", "z03", "z04"}
    assert {b for p, a, b in got if a == "z00"} == {"z01", "z02", "z03", "z04", "z05"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert most_similar(df, "embedding_key", "vector", "profile_key").count() == 0


def test_clusters(spark):
    rows = made(60)
    units = [(i, k) for i, (k, *_) in enumerate(rows)] + [(900, "z00"), (900, "z00"), (901, "nowhere"), (None, "z01"), (902, None)]
    u = spark.createDataFrame(units, "unit_id long, embedding_key string")
    v = spark.createDataFrame([r for r in rows if r[2] == "a"], SCHEMA)
    at, c = unit_clusters(u, v)
    got = {r.unit_id: r.cluster_id for r in at.collect()}
    # reference: components of all links at 0.9
    use = [(k, np.array(x, np.float32).astype(float)) for k, x, p, _ in rows if p == "a" and k and x is not None and len(x) == 16 and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    keys = sorted({k for k, _ in use})
    vec = dict(use)
    label = {k: k for k in keys}
    for _ in range(20):
        for a in keys:
            for b in keys:
                if a < b and round(float(vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b]))), 4) >= 0.9:
                    label[a] = label[b] = min(label[a], label[b])
    mine = {}
    for uid, k in units:
        if uid is not None and k in label:
            mine.setdefault(label[k], set()).add(uid)
    want = {x: min(g) for g in mine.values() if len(g) > 1 for x in g}
    assert got == want
    d = {r.cluster_id: r for r in describe(at, c).collect()}
    assert set(d) == set(got.values())
    for cid, r in d.items():
        members = {x for x, y in got.items() if y == cid}
        assert r["size"] == len(members) and set(r.typical) <= members and len(r.typical) == min(3, len(members))


def test_labels_of_chains(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1), (n + 2, n + 3), (n + 3, n + 4), (n + 2, n + 4)], "a long, b long")
    got = {r.rid: r.label for r in spectral_labels(edges).collect()}
    assert got == {i: 0 if i < n else n if i < n + 2 else n + 2 for i in range(n + 5)}
