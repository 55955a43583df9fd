"""The operators' queries with SQL give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from quillspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, small)
    result = con.execute(queries.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, ([r[c] for c in names] for r in got.collect()))) == sorted(map(str, map(list, result.fetchall())))
