"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from workload.compare import connect

    return connect(SF)


def names():
    from workload.queries import QUERIES

    return list(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    from workload.compare import difference

    rows, problem = difference(spark, con, SF, name)
    assert rows > 0 and not problem


def test_entry(spark):
    import __spark_entry__ as driver

    from workload.queries import QUERIES

    assert QUERIES.keys() <= driver.oracle_sql().keys() <= driver.queries().keys()
    assert driver.entry(spark).count() > 0
