"""Every query with SQL gives DuckDB's rows; every other one runs."""

import glob
import os

import duckdb
import pytest

from driftmesh.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return f"{float(v):.5f}".replace("-0.00000", "0.00000")
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    rows = duck.execute(catalog.SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rows.fetchall())
    assert len(got) == len(want)
    if got != want:  # a rounding in the last place may differ
        for a, b in zip(got, want, strict=True):
            for x, y in zip(a, b, strict=True):
                assert x == y or abs(float(x) - float(y)) < 2e-5


#: Minutes of model fitting.
LONG = {"model_table"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - LONG))
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
