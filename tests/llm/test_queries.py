"""Registered queries on the smallest tables: SQL where there is some, and the entry's names."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

from tessera.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else v  # noqa: E731  # longs beside nulls
    df = df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), None)
    return sorted(str(tuple(map(str, map(whole, r)))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}) == list(range(1, 14))
