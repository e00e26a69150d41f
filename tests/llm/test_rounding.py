import numpy as np
import pytest

from strataloom.llm.similar import Hashing, most_similar

SCHEMA = "embedding_key string, vector array<float>, profile_key string, cos double"


@pytest.mark.parametrize("how", [Hashing(), Hashing(bucket_rows=2)])
def test_cosines_that_round_to_the_threshold(spark, how):
    # 0.89997 counts as 0.9 and 0.89993 does not, whatever the size of a block
    rows = []
    for i, c in enumerate((0.89997, 0.89993)):
        rows += [(f"{i}{j}{e}", np.roll(v, 2 * j + 8 * i).tolist(), "p", 0.0) for j in range(4) for e, v in (("a", [1.0] + [0.0] * 15), ("b", [c, np.sqrt(1 - c * c)] + [0.0] * 14))]
    got = {(r.key, r.neighbor) for r in most_similar(spark.createDataFrame(rows, SCHEMA), "embedding_key", "vector", "profile_key", how=how).collect()}
    assert got == {(f"0{j}{x}", f"0{j}{y}") for j in range(4) for x, y in ("ab", "ba")}
