import os

import pytest

from strataloom import plans
from tests.compare import connect, rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.queries(), plans.oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
