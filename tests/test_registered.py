"""Every registered query against its SQL twin on the smallest folder."""

import pytest

import __spark_entry__ as entry
from checks.compare import duck, run_one

FOLDER = "/root/testdata/sf0.001"
#: Where the smallest folder has no rows for a query.
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and "route_id" in rows.columns


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    text, good = run_one(spark, con, FOLDER, name, query, sql, entry.without_sql())
    if text.startswith("EMPTY"):
        text, good = run_one(spark, duck(LARGER), LARGER, name, query, sql, entry.without_sql())
    assert good, text
