"""Training throughput from step logs.

One log row is (run_id, log_id, ts, step). A run's first row marks its begin; a
row without a step changes nothing else. Progress is measured against the
highest step so far, so a step that repeats or goes back logs nothing and only
moves the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chatloom.operators.scan import slice_rows

# Fixed value: the shortest interval, in seconds, used as a divisor.
MIN_SECONDS = 1e-9

STATE_COLUMNS = "run_id BIGINT, begin_us BIGINT, last_us BIGINT, top_step BIGINT"


def tokens_per_step(
    max_seq_len: int, batch_size: int, world_size: int = 1, accumulation: int = 1
) -> int:
    return max_seq_len * batch_size * max(world_size, 1) * max(accumulation, 1)


def _events(log: DataFrame) -> DataFrame:
    clock = F.unix_micros(F.col("ts").cast("timestamp"))
    return log.select(
        "run_id",
        F.lit(1).alias("is_log"),
        clock.alias("ts_us"),
        F.col("log_id").cast("bigint").alias("log_id"),
        F.col("step").cast("bigint").alias("step"),
        clock.alias("begin_us"),
    )


def _state_events(state: DataFrame) -> DataFrame:
    """What a run left behind, as one row in front of its new rows."""
    return state.select(
        "run_id",
        F.lit(0).alias("is_log"),
        F.coalesce("last_us", "begin_us").alias("ts_us"),
        F.lit(None).cast("bigint").alias("log_id"),
        F.col("top_step").alias("step"),
        "begin_us",
    )


def _seconds(since: Column) -> Column:
    return F.greatest((F.col("ts_us") - since) / F.lit(1e6), F.lit(MIN_SECONDS))


def throughput(
    log: DataFrame, tokens_in_step: int, state: DataFrame | None = None, **slicing
) -> DataFrame:
    """Tokens per second since the last log row and since the run's begin.

    ``state`` (see ``next_state``) continues runs begun in earlier batches.
    """
    events = _events(log)
    if state is not None:
        events = events.unionByName(_state_events(state))
    order = ["ts_us", "is_log", "log_id"]
    sliced = slice_rows(events, order, ["run_id"], **slicing)
    stepped_at = F.when(F.col("step").isNotNull(), F.col("ts_us"))
    carried = sliced.with_carry({
        "_begin": (F.min("begin_us"), F.min),
        "_last": (F.max(stepped_at), F.max),
        "_top": (F.max("step"), F.max),
    })
    here = sliced.window()
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begin = F.coalesce("_begin", F.min("begin_us").over(upto))
    placed = carried.select(
        "run_id", "log_id", "step", "ts_us", "is_log",
        begin.alias("begin_us"),
        F.coalesce(F.max(stepped_at).over(before), F.col("_last"), begin).alias("last_us"),
        F.coalesce(
            F.greatest(F.lit(0), F.max("step").over(before), F.col("_top")), F.lit(0)
        ).alias("last_step"),
    )
    moved = placed.filter("is_log = 1 AND step > last_step")
    per_step = F.lit(float(tokens_in_step))
    delta = F.col("step") - F.col("last_step")
    return moved.select(
        "run_id", "log_id", "step",
        (per_step * delta / _seconds(F.col("last_us"))).alias("tokens_per_sec"),
        (per_step * F.col("step") / _seconds(F.col("begin_us"))).alias("tokens_per_sec_avg"),
    )


def next_state(log: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """One row per run after ``log``: begin, last stepped log time, highest step."""
    events = _events(log)
    if state is not None:
        events = events.unionByName(_state_events(state))
    stepped_at = F.when(F.col("step").isNotNull(), F.col("ts_us"))
    return events.groupBy("run_id").agg(
        F.min("begin_us").alias("begin_us"),
        F.max(stepped_at).alias("last_us"),
        F.max("step").alias("top_step"),
    )
