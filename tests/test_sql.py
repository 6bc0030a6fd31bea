import os

import pytest

from sparkmill.plans import aggregates, checks, data, ingest, keyed, listings, series, text
from tests.agreement import DATA, agree, duck

GROUPS = [data, keyed, series, aggregates, text, ingest, listings, checks]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", [n for g in GROUPS for n in g.SQL])
def test_query_agrees_with_its_sql(spark, con, name):
    g = next(g for g in GROUPS if name in g.SQL)
    agree(spark, con, g.QUERIES[name], g.SQL[name])
