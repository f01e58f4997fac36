"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
import os

import duckdb
import pytest

from mensura import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, oracle, name):
    df = core.QUERIES[name](spark, DATA)
    rel = oracle.sql(core.SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql(spark, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_suggestions_at_their_thresholds(spark, tmp_path):
    con = duckdb.connect()
    for t in ("nation", "supplier", "part", "lineitem"):
        only = " WHERE l_suppkey % 11 IN (3, 6)" if t == "lineitem" else ""
        con.execute(f"COPY (SELECT * FROM '{DATA}/{t}.parquet'{only}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = core.QUERIES["qty13_suggestions"](spark, str(tmp_path))
    rel = con.sql(core.SQL["qty13_suggestions"])
    want = rows(rel.columns, rel.fetchall())
    assert want and rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
