"""Every query that has SQL against DuckDB on the smallest tables; the rest for rows."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from loomwork import jobs

QUERIES, ORACLES = jobs.queries(), jobs.oracles()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = int(v) if v % 1 == 0 else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (bool, int)) or v is None:
        return v
    return str(v) if not isinstance(v, datetime.datetime) else v.isoformat()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)
