import os

import pytest

import __spark_entry__
from loomspark.plans import data_quality, evidence_queries, knowledge_queries, publication_queries, review_queries, source_queries
from tests.oracle import SF, differences

MODULES = [data_quality, evidence_queries, knowledge_queries, publication_queries, review_queries, source_queries]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.ORACLES])
def test_equals_sql(spark, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    assert differences(spark, module.QUERIES[name], module.ORACLES[name]) == ([], [], 0)


@pytest.mark.parametrize("name", [n for m in MODULES for n in m.QUERIES if n not in m.ORACLES])
def test_runs(spark, name):
    module = next(m for m in MODULES if name in m.QUERIES)
    df = module.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
