import os

import pytest

from strataloom.llm import queries
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.queries(), queries.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got.columns)
    if name in ORACLES:
        assert rows(got) == rows(connect(FOLDER).execute(ORACLES[name]).df())
