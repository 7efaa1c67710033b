"""Every query with SQL against DuckDB on the smallest tables; the others for rows and a stable schema."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from stratiq import plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")
QUERIES, TWINS = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return repr(float(x))
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    con = duck.execute(TWINS[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.collect(), df.columns) == table(con.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.columns and df.limit(1).count() == 1
