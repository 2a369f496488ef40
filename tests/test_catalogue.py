"""Every catalogue query at the smallest scale against its SQL, value by value."""

import math

import duckdb
import pytest

from tessera.plans import catalogue
from tests.util import connect, rows

D = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db() -> duckdb.DuckDBPyConnection:
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, db, name):
    got = QUERIES[name](spark, D)
    want = db.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.select(*sorted(columns)).collect()) == rows([tuple(r[columns.index(c)] for c in sorted(columns)) for r in want.fetchall()])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    got = QUERIES[name](spark, D).collect()
    assert got
    for r in got[:50]:
        assert all(not isinstance(x, float) or math.isfinite(x) for x in r)
