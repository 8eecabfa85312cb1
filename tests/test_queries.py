"""Every query against its SQL twin; those without one must give rows."""

import pytest

from compare import connect, rows_of, rows_of_sql
from strandline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Rows that small tables can leave empty.
MAY_BE_EMPTY = {"ag10_trending_items", "st08_sustained_alert"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns, expected = rows_of_sql(con, SQL[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
