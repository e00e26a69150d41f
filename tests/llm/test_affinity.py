import numpy as np

from strataloom.llm.clusters import describe, unit_clusters
from strataloom.llm.similar import Hashing

SCHEMA = "embedding_key string, vector array<float>, profile_key string, cos double"


def test_typical_members_of_large_clusters(spark):
    # more links than are all kept, and members that are no neighbours of each other
    rng = np.random.default_rng(11)
    base = rng.normal(size=64)
    x = (base + rng.normal(size=(90, 64)) * np.where(np.arange(90) % 3, 0.15, 0.4)[:, None]).astype(np.float32)
    x[80:] = x[70]
    rows = [(f"{i:03d}", v.tolist(), "p", 0.0) for i, v in enumerate(x)]
    u = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "unit_id long, embedding_key string")
    at, c = unit_clusters(u, spark.createDataFrame(rows, SCHEMA), how=Hashing(bucket_rows=16))
    members = sorted(r.unit_id for r in at.collect())
    y = x[members].astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    s = y @ y.T
    assert s.min() < 0.9 and len(members) > 50
    affinity = np.round(s.sum(1) - 1, 6)
    want = [members[i] for i in np.lexsort((members, -affinity))[:3]]
    assert [list(r.typical) for r in describe(at, c).collect()] == [want]
