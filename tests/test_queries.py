"""Every registered query against its SQL."""

import pytest

from suite.all_queries import QUERIES, SQL
from suite.check import database, differences


@pytest.fixture(scope="module")
def connection(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, sf_dir, connection, key):
    df = QUERIES[key](spark, sf_dir)
    if key in SQL:
        assert differences(df, connection, SQL[key]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "icu_stay_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())
