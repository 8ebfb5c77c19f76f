"""Every registered query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from evoframe.plans.catalogue import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
