import os

import pytest

from loomspark.llm import queries
from tests.oracle import SF, differences

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == ([], [], 0)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES])
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
