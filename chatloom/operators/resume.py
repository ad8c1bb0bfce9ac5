"""Resume: leave out what an earlier run has written, and report on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chatloom.operators.scan import SLICE, slice_rows


def distinct_keys(done: DataFrame, *keys: str) -> DataFrame:
    return done.select(*keys).dropna().distinct()


def not_done(source: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not among the finished ones.

    A null key is never finished, here as in all functions of this module. AQE
    broadcasts the finished keys when their measured size allows it and otherwise
    joins by shuffle, splitting hot partitions of ``source``.
    """
    return source.join(done.select(*keys), list(keys), "left_anti")


def already_done(source: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    return source.join(done.select(*keys), list(keys), "left_semi")


def resume_report(source: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """One row: rows in the source, rows already done, rows to do."""
    finished = distinct_keys(done, *keys).withColumn("_done", F.lit(True))
    flagged = source.select(*keys).join(finished, list(keys), "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("rows_total"),
        F.count_if(F.col("_done")).alias("rows_done"),
        F.count_if(F.col("_done").isNull()).alias("rows_todo"),
    )


def todo_keys(source: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Set difference of the keys; null keys stay to do."""
    return source.select(*keys).subtract(done.select(*keys).dropna())


# As many rows one task may merge and sort.
FEW_ROWS = 10_000


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in key order; n <= 0 keeps all. Take it after ``not_done``.

    Few rows are merged from the tasks' own first ones, in order. More are selected
    where they stand: see ``select_first``.
    """
    if n <= 0:
        return df
    return df.orderBy(*order).limit(n) if n <= FEW_ROWS else select_first(df, n, *order)


def select_first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in key order, in no order, by finding the n-th key.

    Slices of the key are counted; the one with the n-th row is sliced and counted
    anew until it holds few rows or one key. Slices before it are taken whole by a
    filter on the key, and of the last one as many rows as are missing, so no task
    merges what is selected. Rows of one key are told apart by the hash of their
    other columns; equal rows stand for each other.
    """
    hashed = F.xxhash64(*df.columns)
    rows = df.withColumn("_hash", hashed)
    keys = [*order, "_hash"]
    taken, open_, missing = [], rows, n
    while True:
        sliced = slice_rows(open_, keys).rows
        counts = sorted(sliced.groupBy(SLICE).count().collect())
        if sum(r["count"] for r in counts) <= missing:
            taken.append(open_)
            break
        for slice_, count in counts:
            if count > missing:
                break
            missing -= count
        taken.append(sliced.filter(F.col(SLICE) < slice_).drop(SLICE))
        open_ = sliced.filter(F.col(SLICE) == slice_).drop(SLICE)
        if not missing:
            break
        if count <= FEW_ROWS or count == sum(r["count"] for r in counts):
            taken.append(_ranked(open_, keys, missing))
            break
    whole = taken[0]
    for part in taken[1:]:
        whole = whole.unionByName(part)
    return whole.drop("_hash")


def _ranked(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n of rows that no slice can tell apart any more, or that are few."""
    return rows.orderBy(*keys).limit(n)


def attach_summaries(pending: DataFrame, summaries: DataFrame, key: str = "source_idx") -> DataFrame:
    """Pending rows with their summary by key; a missing one is ''."""
    joined = pending.join(summaries.select(key, "summary"), key, "left")
    return joined.withColumn("summary", F.coalesce("summary", F.lit("")))
