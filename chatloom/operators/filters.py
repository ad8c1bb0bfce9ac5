"""Row filters and their before/after counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: tokens a chat layout may add on top of the counted ones.
LENGTH_MARGIN = 128


def within_length(tokens: str, max_seq_len: int, margin: int = LENGTH_MARGIN) -> Column:
    """Length filter; a missing count stays in. Reaches the Parquet scan as written."""
    return F.col(tokens).isNull() | (F.col(tokens) <= max_seq_len + margin)


def language_is(language: Column, wanted: str) -> Column:
    """python, cpp or any."""
    return F.lit(True) if wanted == "any" else language == wanted


def row_share(index: str, shares: int, share: int) -> Column:
    """A deterministic 1/shares slice of the rows."""
    return F.pmod(F.col(index), F.lit(shares)) == share


def filter_counts(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows before and after a filter, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(predicate).alias("rows_after")
    )
