"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check_queries import canonical, database

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    return database(sf)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got).equals(canonical(want))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 25 and {"data", "mc", "ratio", "ratio_err"} <= set(rows[0].asDict())
