import pytest

from factlake.llm.registry import ORACLES, QUERIES

from ..oracle import agree, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, sf, name):
    agree(spark, con, QUERIES[name], ORACLES[name], sf)
