"""Every query with SQL gives DuckDB's rows; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from wheelwork import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    columns = ["bike", "start_time", "finish_time", "start_place", "finish_place"]
    batch = queries.QUERIES["rides_from_changes"](spark, DATA).select(*columns)
    stream = queries.QUERIES["stream_rides"](spark, DATA).select(*columns)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
