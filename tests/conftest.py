from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__  # noqa: E402,F401  (registers the packages for Python workers)
from chatloom.session import tune  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def conf(spark):
    """Set SQL settings for one test."""
    changed = {}

    def change(key, value):
        changed.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def eval_one(spark):
    """Evaluate one Column function over a list of texts."""

    def run(rule, texts):
        table = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
        rows = table.select("i", rule(table["t"]).alias("v")).collect()
        return [row["v"] for row in sorted(rows)]

    return run


def final_plan(df) -> str:
    """The adaptive plan after execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()
