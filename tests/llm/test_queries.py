"""The queries of the operators against their SQL."""

import duckdb
import pytest

from lektra.llm import queries
from tests.test_oracles import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    wanted = sorted((tuple(plain(dict(zip(names, r))[n]) for n in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr) == wanted
