"""Every registered query against its SQL on the smallest tables."""

import pytest

import oracle
from msgsieve.plans import catalog, catalog_sql, learning_sql

SQL = catalog_sql.SQL | learning_sql.SQL


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data, con):
    assert oracle.compare(spark, con, data, catalog.QUERIES[name], SQL[name]) == ""


def test_entry_runs(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
