"""Every query of the catalogue agrees with its SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from ledgerloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", list(catalogue.ORACLE))
def test_query_agrees(spark, duck, name):
    df, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE[name])
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 11
    assert set(catalogue.ORACLE) <= set(__spark_entry__.queries())


def test_time_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans import views

    df = views.usage_events(spark, SF).where(F.col("model") == "unknown").select("input_tokens")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
