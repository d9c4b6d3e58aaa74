"""Registered queries of the subpackage against their SQL, and the pipeline."""

import pytest
from compare import connect, difference

from docloom.llm import queries


@pytest.fixture(scope="module")
def database(directory):
    return connect(directory)


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_equals_sql(spark, directory, database, name):
    assert difference(queries.QUERIES[name](spark, directory), database, queries.CHECKS[name]) is None


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in entry.queries()
