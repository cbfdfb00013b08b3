"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import compare, duck

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_every_oracle_has_its_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 201
    assert sum(r["amount_mean"] is not None for r in rows) == 69
    assert sum(r["amount_mean"] or 0 for r in rows) == pytest.approx(3365.631667, abs=1e-4)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, small, name):
    assert compare(QUERIES[name](spark, small).toPandas(), con.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
