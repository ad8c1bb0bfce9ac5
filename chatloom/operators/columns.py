"""Helpers on DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters read but do not evaluate again.

    A filter on a plain ``withColumn`` is pushed below it together with the
    expression, so a costly pattern runs once for the filter and again for the
    output. A one-row ``inline`` keeps such filters above it.
    """
    made = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*df.columns, F.inline(F.array(made)).alias(*columns))
