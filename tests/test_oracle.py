"""Every registered query with an oracle text equals DuckDB on the sf0.001 tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL

TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "item"):
        return _norm(v.item())
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(SMALL) / (t + '.parquet')}')")
    return c


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _canon(df.columns, rows) == _canon(ocols, orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["geohash", "mean_demand", "lanes", "lat", "lon"]
    assert 0 < df.count() <= 10


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
