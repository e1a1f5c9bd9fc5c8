"""Every registered query against its SQL, as the driver does it."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lektra.plans import registry

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    wanted = sorted((tuple(plain(dict(zip(names, r))[n]) for n in order) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in order) for r in rows), key=repr)
    assert len(got) == len(wanted)
    assert got == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
