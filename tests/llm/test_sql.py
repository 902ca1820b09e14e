"""Queries that have SQL give its rows."""

from __future__ import annotations

import duckdb
import pytest

from ebbflow.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None else round(float(v), 8) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=str)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(plain(v) for v in r) for r in want), key=str)
