"""Every registered query is equal to its SQL."""

import pytest
from compare import connect, difference

from docloom import catalog

catalog.load()


@pytest.fixture(scope="module")
def database(directory):
    return connect(directory)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_equals_sql(spark, directory, database, name):
    assert difference(catalog.QUERIES[name](spark, directory), database, catalog.CHECKS[name]) is None


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.CHECKS)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "filename", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
