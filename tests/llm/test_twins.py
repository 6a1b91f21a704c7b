"""Queries with SQL twins against DuckDB."""

import duckdb
import pytest

from sheaf.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, data, name):
    sf = data.replace("0.001", "0.01")
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
