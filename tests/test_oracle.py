"""Every query with SQL gives the same rows in both engines."""

import glob
import math
import os

import pytest
from conftest import SF

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.9g}")) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    rows = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    assert got == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
