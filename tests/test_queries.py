"""Every registered query against its reference SQL, and the shape of its plan."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import __spark_entry__ as contract
from chatloom.operators.filters import row_share, within_length
from check import TABLES, rows_of
from workload import oracle
from workload.queries import REGISTRY


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(REGISTRY) == set(oracle.statements())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_its_sql(spark, db, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(contract.oracle_sql()[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_the_length_filter_reaches_the_scan(spark):
    plan = contract.queries()["filtered_table"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(num_tokens_serialized),LessThanOrEqual(num_tokens_serialized" in plan
    assert "messages" not in plan.split("ReadSchema")[1]


def test_costly_patterns_run_once(spark):
    plan = contract.queries()["token_guard"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(reply") == 2  # last block, last reasoning text


def test_filters(spark):
    df = spark.createDataFrame([(0, None), (1, 228), (2, 229)], "i INT, n INT")
    assert [r["i"] for r in df.filter(within_length("n", 100)).collect()] == [0, 1]
    assert [r["i"] for r in df.filter(row_share("i", 2, 0)).collect()] == [0, 2]
    assert [r["i"] for r in df.select((F.col("i") - 3).alias("i")).filter(row_share("i", 2, 1)).collect()] == [-3, -1]
