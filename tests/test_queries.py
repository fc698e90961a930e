"""Every registered query: equal to its SQL twin, or at least non-empty and stable in schema."""

import pytest
from compare import connect, differences

from vigilbus.queries import load_all

QUERIES = load_all()
CHECKED = [n for n, q in QUERIES.items() if q.sql]
UNCHECKED = [n for n, q in QUERIES.items() if not q.sql]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, sf, con, name):
    q = QUERIES[name]
    assert differences(spark, con, q.run, q.sql, sf) is None


@pytest.mark.parametrize("name", UNCHECKED)
def test_has_rows(spark, sf, name):
    rows = QUERIES[name].run(spark, sf)
    assert rows.columns and rows.limit(1).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[:2] == ["vehicle_id", "signal"]
