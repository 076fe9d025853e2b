"""Every query with a twin gives the rows of its twin on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from paperloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rows = duck.execute(registry.SQL[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rows.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_a_twin_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() >= 0
