"""Operator queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tailspark.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    result = con.execute(SQL[name])
    columns = sorted(c[0] for c in result.description)
    assert columns == sorted(df.columns)
    at = {c[0]: i for i, c in enumerate(result.description)}
    want = sorted([str(r[at[c]]) for c in columns] for r in result.fetchall())
    assert sorted([str(r[c]) for c in columns] for r in df.collect()) == want


def test_one_query_per_operator():
    names = registry.queries()
    assert {n.split("_")[0] for n in names} == {"pipeline", *(f"op{k}" for k in range(1, 11))} and len(names) == 11
