"""Every query with SQL gives the same rows as the SQL engine on the smallest tables."""

from __future__ import annotations

import math
import os

import pytest
from conftest import SMALL

from tidewater.plans import registry

if not os.path.isdir(SMALL):
    pytest.skip("needs the driver's tables", allow_module_level=True)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return str(x)


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if sql])
def test_same_rows(spark, duck, name):
    fn, sql = registry.QUERIES[name]
    ours = fn(spark, SMALL)
    names = sorted(ours.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in ours.collect())
    cursor = duck.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    want = sorted(repr([plain(dict(zip(theirs, r))[c]) for c in names]) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n, (_, sql) in registry.QUERIES.items() if not sql])
def test_rows_only(spark, name):
    assert registry.QUERIES[name][0](spark, SMALL).count() > 0
