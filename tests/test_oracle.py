"""Every query of the library's own operators runs, and agrees with its SQL."""

import pytest
from parity import compare

from leafmill.queries import load

QUERIES, SQL = load()


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
