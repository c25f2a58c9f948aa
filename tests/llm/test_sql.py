"""Numbered queries with SQL give DuckDB's rows on the small tables, floats included."""

import duckdb
import pytest

from inkwell.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.sql(f"create view {name_} as select * from '{DATA}/{name_}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r[c] for c in want.columns) for r in got.collect())
    assert rows == sorted(want.fetchall()) and rows


EDGES = [(1, None, "a", "en"), (2, "", None, None), (3, "one two three", "a", ""), (4, "One two three", None, "en"), (5, "x " * 400, "b", "de"), (6, "x " * 400, "b", None), (7, "é" * 300, "c", "en")]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_edges(spark, name, tmp_path):
    spark.createDataFrame(EDGES, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (5, 0, 1), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name_ in ("documents", "labels"):
        con.sql(f"create view {name_} as select * from '{tmp_path}/{name_}.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    assert sorted(tuple(r[c] for c in want.columns) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())
