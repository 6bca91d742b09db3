"""Every query with SQL gives the SQL's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import evaluation, models, structure, support

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(df):
    """Rows with columns by name, floats to 9 places, in order."""
    df = df[sorted(df.columns)]

    def value(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "") == "f" else int(v) if isinstance(v, int) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "u") else str(v)

    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False)), key=str)


CASES = [(f, {**evaluation.ORACLES, **structure.ORACLES, **support.ORACLES, **models.ORACLES}.get(f.__name__)) for f in (*evaluation.QUERIES, *structure.QUERIES, *support.QUERIES, *models.QUERIES)]


@pytest.mark.parametrize(("query", "sql"), CASES, ids=[f.__name__ for f, _ in CASES])
def test_query(spark, duck, query, sql):
    got = query(spark, DATA).toPandas()
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
