from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chatloom.operators import generate, positions, resume


def stored(spark, folder, parts, columns="k BIGINT"):
    for number, keys in enumerate(parts):
        spark.createDataFrame([(k,) for k in keys], columns).coalesce(1).write.mode("append").parquet(f"{folder}/p{number}")
    return spark.read.schema(columns).parquet(*[f"{folder}/p{number}" for number in range(len(parts))])


def test_numbers_do_not_depend_on_splits(spark, tmp_path, conf):
    keys = [(k * 7919) % 20_011 for k in range(20_000)]
    table = stored(spark, tmp_path, [keys[:9000], [], keys[9000:9001], keys[9001:]])
    want = {k: n for n, k in enumerate(keys)}
    for split in ("128m", "4k"):
        conf("spark.sql.files.maxPartitionBytes", split)
        conf("spark.sql.files.openCostInBytes", "0")
        got = positions.number_stored(table, "n").collect()
        assert {r["k"]: r["n"] for r in got} == want and len(got) == 20_000
    # A filter on the numbered rows, not a sort or a shuffle of them.
    plan = positions.number_stored(table, "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert plan.count("Exchange hashpartitioning(_file") <= 1


def test_zip_pairs_rows_by_place(spark, tmp_path):
    one = stored(spark, tmp_path / "a", [[5, 3], [9, 3, 3]], "k BIGINT")
    other = stored(spark, tmp_path / "b", [["v"], ["w", "x", "y"], ["z"]], "v STRING")
    assert sorted(map(tuple, positions.zip_stored(one, other).collect())) == sorted(zip([5, 3, 9, 3, 3], "vwxyz"))
    with pytest.raises(ValueError, match="5 and 4 rows"):
        positions.zip_stored(one, stored(spark, tmp_path / "c", [["v"], ["w", "x", "y"]], "v STRING"))
    with pytest.raises(ValueError, match="columns"):
        positions.zip_stored(one, one)


@pytest.mark.parametrize("n", [1, 700, 1500, 2999, 3000, 9000])
def test_selection_equals_the_sort(spark, monkeypatch, n):
    monkeypatch.setattr(resume, "FEW_ROWS", 50)
    rows = [(None if k % 50 == 0 else k % 9, (k * 7919) % 3001, f"text {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "g INT, k INT, t STRING").repartition(5)
    got = resume.first_rows(df, n, "g", "k").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))[:n]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_ties_and_equal_rows_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(resume, "FEW_ROWS", 10)
    ties = spark.range(2000).select(F.lit(1).alias("k"), "id")
    assert resume.first_rows(ties, 777, "k").distinct().count() == 777
    equal = spark.range(500).select(F.lit(1).alias("k"))
    assert resume.first_rows(equal, 123, "k").count() == 123
    assert resume.first_rows(equal, 0, "k").count() == 500


def test_large_samples_are_not_merged_in_one_task(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("k"), F.repeat(F.lit("x"), 20).alias("t"))
    chosen = resume.first_rows(df, 50_000, "k")
    assert chosen.agg(F.count("t"), F.max("k")).first() == (50_000, df.orderBy("k").limit(50_000).agg(F.max("k")).first()[0])
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    limits = [int(line.split("GlobalLimit ")[1].split()[0].rstrip(",")) for line in plan.split("\n") if "GlobalLimit" in line]
    assert all(limit <= resume.FEW_ROWS for limit in limits)


def test_batches_of_like_lengths(spark):
    texts = [(k, None if k % 7 == 0 else "x" * ((k * 37) % 400 + 1)) for k in range(300)]
    df = spark.createDataFrame(texts, "k INT, p STRING").coalesce(2)

    def echo(batch):
        assert len(batch) <= 16 and (len(batch) == 1 or max(map(len, batch)) * len(batch) <= 2000)
        return [f"{len(p)}" for p in batch]

    made = generate.generate_by_length(df, "p", "out", echo, 2000, 16, padding="padded")
    assert made.columns == ["k", "p", "out", "padded"]
    rows = made.collect()
    assert [(r["k"], r["p"]) for r in rows] == texts
    assert all(r["out"] == ("" if r["p"] is None else str(len(r["p"]))) for r in rows)
    asked = [r for r in rows if r["p"] is not None]
    share = sum(r["padded"] for r in asked) / sum(len(r["p"]) + r["padded"] for r in asked)
    # Batches as they come pad nearly half of what they hold; of like lengths, little.
    came = [asked[k:k + 16] for k in range(0, len(asked), 16)]
    plain = 1 - sum(len(r["p"]) for r in asked) / sum(max(len(r["p"]) for r in b) * len(b) for b in came)
    assert share < 0.1 < plain
    assert all(r["padded"] is None for r in rows if r["p"] is None)


def test_a_text_above_the_budget_stands_alone():
    assert generate.token_batches([5, 1, 100, 2, 2], 8, 3) == [[1, 3, 4], [0], [2]]
    assert generate.token_batches([], 8, 3) == []
