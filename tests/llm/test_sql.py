"""Registered queries of this subpackage that SQL can express, against DuckDB on the same tables."""

from collections import Counter

import duckdb
import pytest

from spanloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns and got
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
