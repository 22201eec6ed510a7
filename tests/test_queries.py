"""Each query against its SQL on the smallest tables."""

import pytest
from conftest import SMALL, duck, rows_of

from borefield.jobs.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    ours, theirs = rows_of(QUERIES[name](spark, SMALL).toPandas()), rows_of(con.sql(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
