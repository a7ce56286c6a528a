"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import os

import duckdb
import pytest

from larkspur import fixtures, plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in fixtures.TABLES:
        con.execute(f"create view {t} as select * from '{os.path.join(SF, t)}.parquet'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{round(float(v), 6):g}" if abs(v) < 1e6 else f"{float(v):.6f}"
    return v.isoformat(sep=" ") if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in plans.SQL:
        assert got
        return
    rel = duck.execute(plans.SQL[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r, strict=True)) for r in rel.fetchall()]
    names = sorted(columns)
    assert sorted([cell(r[c]) for c in names] for r in got) == sorted([cell(r[c]) for c in names] for r in want)
