from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import packing, scan, throughput

CUT = {"slices": 7}


def hot_rows(n=4000, groups=40, seed=1):
    """One group holds a third of all rows; one group key is null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = 0 if i % 3 == 0 else rng.randrange(1, groups)
        rows.append((None if group == 7 else group, rng.randrange(50), i, rng.randrange(100)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("slicing", [{}, CUT])
def test_running_sum_per_group(spark, slicing):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g INT, a INT, b INT, v INT")
    got = scan.running_sum(df, F.col("v").cast("bigint"), "before", ["a", "b"], ["g"], **slicing)
    assert got.columns == ["g", "a", "b", "v", "before"]
    totals, want = {}, set()
    for g, a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        want.add((g, a, b, v, totals.get(g, 0)))
        totals[g] = totals.get(g, 0) + v
    assert {tuple(r) for r in got.collect()} == want


def test_a_hot_group_is_cut_and_its_carry_stays_small(spark):
    df = spark.createDataFrame(hot_rows(), "g INT, a INT, b INT, v INT")
    sliced = scan.slice_rows(df, ["a", "b"], ["g"], **CUT)
    sizes = [r["count"] for r in sliced.rows.groupBy("_slice").count().collect()]
    hot = sliced.rows.filter("g = 0").select("_slice").distinct().count()
    assert len(sizes) == 7 and max(sizes) < 4000 / 3 and hot >= 2
    carried = sliced.with_carry({"n": (F.count("*"), F.sum)})
    assert carried.filter("n IS NOT NULL").select("_slice", "g").distinct().count() <= 6


def test_slices_are_an_expression_of_the_row(spark):
    """Nothing is stored: the plan has one exchange of the rows and no checkpoint."""
    df = spark.createDataFrame(hot_rows(), "g INT, a INT, b INT, v INT")
    plan = scan.number_rows(df, "n", ["a", "b"], ["g"], slices=7)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD[g" in plan or "LocalTableScan" in plan
    assert plan.count("Exchange hashpartitioning(_slice") <= 2  # rows, and their pre-aggregated totals


def test_number_rows_over_the_table(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    numbered = scan.number_rows(df, "idx", ["k"], slices=5).collect()
    assert [r["idx"] for r in sorted(numbered)] == list(range(1000))


def test_pack_sequences(spark):
    rows = [(chat, turn, (chat * 31 + turn * 17) % 90) for chat in range(60) for turn in range(9)]
    df = spark.createDataFrame(rows, "c INT, t INT, n INT").repartition(4)
    got = packing.pack_sequences(df, "n", ["c", "t"], 128, slices=6).collect()
    total, want = 0, []
    for c, t, n in rows:
        want.append((c, t, n, total, total // 128))
        total += n
    assert sorted(tuple(r) for r in got) == want


def replay(rows, per_step):
    """The rule row by row: one clock, one highest step, one total per run."""
    out, runs = {}, {}
    for run, log_id, ts, step in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        now = (ts - dt.datetime(2024, 1, 1)).total_seconds()
        state = runs.setdefault(run, {"begin": now, "clock": now, "top": 0, "total": 0.0})
        if step is None:
            continue
        gained = step - state["top"]
        if gained > 0:
            tokens = per_step * gained
            state["total"] += tokens
            out[run, log_id] = (
                tokens / max(now - state["clock"], 1e-9),
                state["total"] / max(now - state["begin"], 1e-9),
            )
            state["top"] = step
        state["clock"] = now
    return out


def log_rows(n=3000, seed=2):
    rng = random.Random(seed)
    start, steps, rows = dt.datetime(2024, 1, 1), {}, []
    for i in range(n):
        run = 0 if i % 3 == 0 else rng.randrange(1, 12)
        start += dt.timedelta(seconds=rng.choice([0, 1, 5]), microseconds=rng.randrange(1000))
        steps[run] = steps.get(run, -10) + 10
        step = rng.choice([steps[run], steps[run] - 30, steps[run], None])
        rows.append((run, i, start, step))
    return rows


LOG = "run_id LONG, log_id LONG, ts TIMESTAMP, step LONG"


@pytest.mark.parametrize("slicing", [{}, CUT])
def test_throughput_equals_a_replay(spark, slicing):
    rows = log_rows()
    got = throughput.throughput(spark.createDataFrame(rows, LOG), 1000, **slicing).collect()
    want = replay(rows, 1000)
    assert len(got) == len(want)
    for row in got:
        now, mean = want[row["run_id"], row["log_id"]]
        assert row["tokens_per_sec"] == pytest.approx(now, rel=1e-6)
        assert row["tokens_per_sec_avg"] == pytest.approx(mean, rel=1e-6)


@pytest.mark.parametrize("slicing", [{}, CUT])
def test_throughput_in_pieces_equals_the_whole(spark, slicing):
    rows = log_rows()
    whole = throughput.throughput(spark.createDataFrame(rows, LOG), 1000).collect()
    state, pieces = None, []
    for start in range(0, len(rows), 800):
        part = spark.createDataFrame(rows[start:start + 800], LOG)
        pieces += throughput.throughput(part, 1000, state, **slicing).collect()
        state = throughput.next_state(part, state)
    assert sorted(pieces) == sorted(whole)


def test_tokens_per_step():
    assert throughput.tokens_per_step(8192, 1, 8, 8) == 524288
    assert throughput.tokens_per_step(8192, 2, 0, 0) == 16384


def test_ten_thousand_slices_cost_the_logarithm(spark):
    df = spark.range(40_000).select((F.col("id") * 7919 % 40_009).alias("k"), F.col("id").cast("string").alias("s"))
    sliced = scan.slice_rows(df, ["k", "s"], slices=10_000)
    sizes = [r["count"] for r in sliced.rows.groupBy("_slice").count().collect()]
    assert len(sizes) > 5000 and max(sizes) < 100
    keys, found = scan.slice_starts(df, ["k", "s"], 10_000)
    # One step per bit of the number of starts, one literal for all of them.
    place = scan.starts_at_or_before(keys, found, F.struct("k", "s")).alias("place")
    plan = df.select(place)._jdf.queryExecution().optimizedPlan().toString()
    assert "X'" not in plan and f"[{','.join(str(1 << b) for b in range(found.bit_length() - 1, -1, -1))}]" in plan
    assert found.bit_length() <= 14


@pytest.mark.parametrize("count", [0, 1, 2, 3, 7, 8, 100])
def test_halving_finds_the_slice(spark, count):
    starts = F.array(*[F.lit(3 * k) for k in range(count)]).cast("array<bigint>")
    got = spark.range(310).select("id", scan.starts_at_or_before(starts, count, F.col("id")).alias("n")).collect()
    assert [r["n"] for r in got] == [min(count, r["id"] // 3 + 1) for r in got]


def test_one_job_places_the_slices(spark):
    df = spark.createDataFrame(hot_rows(), "g INT, a INT, b INT, v INT")
    tracker, group = spark.sparkContext.statusTracker(), "one-job"
    spark.sparkContext.setJobGroup(group, "")
    try:
        scan.number_rows(df, "n", ["a", "b"], ["g"], slices=7)
        # The sample and its sort: the stages of one query, and no count before it.
        assert len(tracker.getJobIdsForGroup(group)) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keys_of_all_types_keep_their_order(spark):
    rows = [
        (None if k % 9 == 0 else f"gé\"{k % 5}\n", dt.datetime(2024, 1, 1, 0, 0, k % 3, k), bytearray([k % 250, 0, 255]),
         None if k % 7 == 0 else [float("nan"), float("inf"), k / 3][k % 3], dt.date(2024, 1, 1 + k % 28), k)
        for k in range(300)
    ]
    df = spark.createDataFrame(rows, "g STRING, t TIMESTAMP, b BINARY, d DOUBLE, y DATE, k INT").withColumn("n", F.col("t").cast("timestamp_ntz"))
    order = ["t", "n", "b", "d", "y", "k"]
    whole = scan.number_rows(df, "at", order, ["g"], slices=1).select("k", "at").collect()
    cut = scan.number_rows(df, "at", order, ["g"], slices=40).select("k", "at").collect()
    assert sorted(whole) == sorted(cut)
