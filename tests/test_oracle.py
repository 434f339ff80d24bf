"""Every registered query against the SQL oracle on whole tables."""

import pytest
from check import compare, connect

from rillstone.plans import catalog, oracle

QUERIES, SQL = catalog.queries(), oracle.statements()
# At this scale every minute has a full segment; the smallest data set has none.
ON_TINY = {"lr_count_progress"}


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.fixture(scope="module")
def tiny_duck(tiny):
    return connect(tiny)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches(spark, small, tiny, duck, tiny_duck, name):
    folder, duck = (tiny, tiny_duck) if name in ON_TINY else (small, duck)
    result = QUERIES[name](spark, folder)
    assert duck.execute(f"SELECT count(*) FROM ({SQL[name]}) q").fetchone()[0] > 0
    assert compare(result, duck, SQL[name]) is None
