"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import math
import os

import pandas as pd
import pytest

from escrutinio import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def text(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "None"
    return pd.Timestamp(value).isoformat() if hasattr(value, "isoformat") else str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in data)


# Queries whose draws run jobs while their plan is built.
EAGER = {"published_years", "ingested_log", "correlation_bootstrap", "social_correlations", "moran_global_p", "moran_local_p"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == table(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_product_and_no_row_udf(spark, name):
    if name in EAGER:
        pytest.skip("runs jobs while it is built")
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert word not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["votes_by_territory"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_suppkey" in plan
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
