"""Queries of this subpackage against their SQL twins."""

import pytest

from tests.compare import connect, difference
from tickloom.llm.oracles import ORACLE_SQL
from tickloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, sf_dir, name):
    assert difference(spark, sf_dir, QUERIES[name], ORACLE_SQL[name], connect(sf_dir)) == ""
