"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from planlark import plans
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    assert name in plans.ORACLE_SQL
    same(plans.QUERIES[name](spark, SF), plans.ORACLE_SQL[name], con)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
