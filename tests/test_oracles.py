"""Every query with SQL gives DuckDB's rows on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from inkwell.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 5) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = [want.columns.index(c) for c in cols]
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=key)
    assert a == b
    assert a
