"""Row numbers in storage order, and pairing of tables that share nothing but it.

A stored row has a place: its file and its index in the file, which Parquet's
readers tell however a file is split. Files count their rows, names in order give
each file's first number, and the sum is the row's number. Nothing is sorted and no
row is shuffled; what moves is one row per file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _first_numbers(table: DataFrame) -> DataFrame:
    """(_file, _first, _rows) per file: rows are counted without reading a column."""
    counts = table.select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_rows"))
    # As many rows as the table has files, which the driver lists anyway.
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def number_stored(table: DataFrame, out: str) -> DataFrame:
    """Row numbers from 0 in the order of files by name and rows in each file.

    ``table`` is read from Parquet files, with at most narrow steps since.
    """
    placed = table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    numbered = placed.join(F.broadcast(_first_numbers(table).select("_file", "_first")), "_file")
    return numbered.select(*table.columns, (F.col("_first") + F.col("_index")).cast("bigint").alias(out))


def zip_stored(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of two stored tables side by side, first with first and so on.

    For answers that carry no key but come in the order of what was asked. Tables of
    unequal length, or with columns of one name, are refused.
    """
    if shared := set(one.columns) & set(other.columns):
        raise ValueError(f"both tables have the columns {sorted(shared)}")
    lengths = [_first_numbers(table).agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0] for table in (one, other)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"tables of {lengths[0]} and {lengths[1]} rows cannot be paired")
    return number_stored(one, "_number").join(number_stored(other, "_number"), "_number").drop("_number")
