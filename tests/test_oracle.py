"""Every registered query that SQL can express, against DuckDB on the same tables; those on streams, against their batch form."""

from collections import Counter

import duckdb
import pytest

from spanloom.plans import queries as plans  # the package registers all modules

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = plans.Q[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    result = duck.execute(plans.SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall()) and got


@pytest.mark.parametrize("name", sorted(set(plans.Q) - set(plans.SQL)))
def test_runs(spark, sf, name):
    assert plans.Q[name](spark, sf).count() > 0


def test_stream_equals_batch(spark, sf):
    from spanloom.streaming import live
    from pyspark.sql import functions as F

    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert Counter(plans.Q["q_stream_windows"](spark, sf).collect()) == Counter(live.counts_by_window(batch).collect())
    closed = Counter(plans.Q["q_stream_sessions"](spark, sf).collect())
    every = Counter(live.sessions(batch).collect())
    assert not closed - every and sum((every - closed).values()) <= 0.1 * sum(every.values())  # the rest is still open at the watermark


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
