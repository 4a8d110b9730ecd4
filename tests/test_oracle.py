"""Every core query with SQL gives DuckDB's rows; every other one runs."""

import pytest

from sievemill.plans import problems, registry
from tests.conftest import SMALL
from tests.oracle import compare

QUERIES = registry.QUERIES | problems.QUERIES
SQL = registry.SQL | problems.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    compare(spark, SMALL, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0


def test_every_platform_is_replayed(spark):
    from sievemill.sources.feeds import FEEDS

    rows = QUERIES["s01_replay"](spark, SMALL).collect()
    assert {r["kind"] for r in rows} == set(FEEDS) and all((r["ok"], r["failed"], r["n"]) == (1, 1, 1) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
