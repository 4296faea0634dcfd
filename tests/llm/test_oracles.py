"""Numbered queries with SQL against DuckDB on the smallest tables."""

import glob
import os

import pytest

pytest.importorskip("docketry.llm")

import duckdb  # noqa: E402
from docketry.llm import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = catalog.QUERIES[name](spark, SF)
    relation = connection.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == sorted(df.columns)
    at = [relation.columns.index(c) for c in df.columns]
    own = sorted((tuple(r) for r in df.collect()), key=repr)
    assert own == sorted((tuple(r[k] for k in at) for r in relation.fetchall()), key=repr)
