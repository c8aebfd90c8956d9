"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

from plumbline.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())
