"""Every analysis query against its SQL twin in DuckDB."""

import pytest

from tests.compare import connect, difference
from tickloom.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf_dir, con, name):
    assert difference(spark, sf_dir, QUERIES[name], ORACLE_SQL[name], con) == ""


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
