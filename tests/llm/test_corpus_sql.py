"""Corpus queries with SQL return the same rows as DuckDB does over the same tables."""

import os

import duckdb
import pytest

from tidemark.llm.queries import oracle_sql, queries

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in want.fetchall())
