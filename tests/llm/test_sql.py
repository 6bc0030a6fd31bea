import os

import pytest

from sparkmill.llm.queries import QUERIES, SQL
from tests.agreement import DATA, agree, duck


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(spark, name):
    agree(spark, duck(), QUERIES[name], SQL[name])
