"""Pack samples into training sequences of a fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatloom.operators.scan import running_sum


def pack_sequences(
    df: DataFrame, tokens: str, order: list[str], max_seq_len: int, **slicing
) -> DataFrame:
    """Add ``token_start`` (tokens before the row) and ``bin`` (its sequence)."""
    counts = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    placed = running_sum(df, counts, "token_start", order, **slicing)
    bins = F.floor(F.col("token_start") / F.lit(max_seq_len)).cast("bigint")
    return placed.withColumn("bin", bins)
