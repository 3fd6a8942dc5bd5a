"""Every registered query with a SQL twin gives the rows DuckDB gives."""

import pytest
from compare import connect, difference

from holdfast.catalog import collect

QUERIES, ORACLES = collect()
#: Streams, and trained jobs of half a minute and more.
SLOW = {n for n in ORACLES if n.endswith(("_stream", "_holds", "_twins", "_declared", "_ledger"))
        or n.startswith(("p1_stream", "a10", "l3_l6", "n5_"))}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows_as_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLES[name]) is None


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
