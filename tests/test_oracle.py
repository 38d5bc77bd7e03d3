"""Every registered query against its SQL on the small tables."""

import collections
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, np.ndarray):
        return tuple(plain(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = collections.Counter(
        tuple(plain(v) for v in r) for r in db.execute(f"SELECT {quoted} FROM ({sql})").fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
