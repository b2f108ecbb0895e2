"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
import oracle
from plumbline.catalog import REGISTRY

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("label", sorted(REGISTRY))
def test_query(spark, tables, label):
    df = entry.queries()[label](spark, SF_DIR)
    sql = entry.oracle_sql().get(label)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, tables, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 17
