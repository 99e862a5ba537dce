"""Every registered query against its SQL on the same tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as driver

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLE[name], con) == []


def test_flagship(spark):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
