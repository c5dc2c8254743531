"""Every registered store query against its DuckDB statement on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from opalyx import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, found):
    clean = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else (f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))
    at = sorted(range(len(columns)), key=columns.__getitem__)
    out = [tuple(clean(r[k]) for k in at) for r in found]
    return sorted(out, key=lambda t: tuple((x is None, x or "") for x in t))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF), duck.sql(Q.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(got.columns, got.collect())
    assert found and found == rows(want.columns, want.fetchall())


def test_entry_has_rows(spark):
    assert Q.entry(spark, SF).count() > 0
