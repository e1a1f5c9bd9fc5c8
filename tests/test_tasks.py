"""Joins that are dealt to tasks by their rows."""

import duckdb
import pytest

from lektra.operators import relational as R
from lektra.plans import registry
from tests.conftest import SF


def by_sql(name):
    con = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "events", "documents", "embeddings", "labels", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return sorted(con.execute(registry.oracle_sql()[name]).fetchall())


@pytest.mark.parametrize("name", ["j9_anti_audits", "d5_cascade_delete_collections", "d7_cascade_delete_assets"])
def test_joins_dealt_by_their_rows(spark, monkeypatch, name):
    monkeypatch.setattr(R, "TASK_ROWS", 900)
    found = registry.queries()[name](spark, SF)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == by_sql(name)


def test_null_keys_stay_and_are_not_dealt(spark):
    rows = [(None if i % 3 == 0 else i % 50, i) for i in range(900)]
    kept = R.deleted(spark.createDataFrame(rows, "k long, i long"), spark.createDataFrame([(7,), (8,), (None,)], "gone long"), "k", 6)
    assert sorted(r.i for r in kept.collect()) == [i for k, i in rows if k not in (7, 8)]
    assert R.tasks_for(0) == 1 and R.tasks_for(R.TASK_ROWS, 1) == 2
