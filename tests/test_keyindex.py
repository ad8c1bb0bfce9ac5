from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F, types as T

from chatloom.operators import keyindex
from chatloom.operators.keyindex import KeyIndex
from chatloom.sources.writers import append_new

TEXTS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType()), T.StructField("v", T.StringType())])
NUMBERS = T.StructType([T.StructField("n", T.LongType()), T.StructField("v", T.StringType())])


def numbers(spark, keys):
    return spark.createDataFrame([(k, f"value {k}") for k in keys], NUMBERS)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_dense_keys_are_bits(spark, tmp_path):
    folder, rng = str(tmp_path), random.Random(3)
    keys = [rng.randrange(-70_000, 200_000) for _ in range(3000)] + [-1, 0, 1, 32_767, 32_768, 32_769, 65_536]
    numbers(spark, [*keys, None, 5]).write.parquet(f"{folder}/t")
    index = KeyIndex(spark, f"{folder}/t", f"{folder}/i", NUMBERS, "n", dense=True)
    index.refresh()
    asked = [rng.randrange(-70_000, 200_000) for _ in range(3000)] + keys[:500] + [-1, 0, 1, 32_767, 32_768, 32_769, 65_536, 65_537]
    want = sorted((k,) for k in set(asked) & {*keys, 5})
    assert found(index.finished(numbers(spark, [*asked, None]))) == want
    with pytest.raises(ValueError):
        KeyIndex(spark, f"{folder}/t", f"{folder}/j", TEXTS, "a", dense=True)


def test_other_keys_are_filtered_and_looked_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyindex, "LEAST_BUCKETS", 2)
    folder = str(tmp_path)
    rows = [(f"k{k}", k % 3, "x") for k in range(2000)] + [(None, 1, "x"), ("k1", None, "x")]
    spark.createDataFrame(rows, TEXTS).write.parquet(f"{folder}/t")
    index = KeyIndex(spark, f"{folder}/t", f"{folder}/i", TEXTS, "a", "b")
    index.refresh()
    # Two crowded filters let many keys through, the stored keys none.
    asked = [(f"k{k}", k % 2, "y") for k in range(0, 6000, 7)] + [(None, 1, "y"), ("k1", None, "y")]
    want = sorted((a, b) for a, b, _ in set(asked) if a and b is not None and int(a[1:]) < 2000 and int(a[1:]) % 3 == b)
    assert found(index.finished(spark.createDataFrame(asked, TEXTS))) == want


@pytest.mark.parametrize("dense", [True, False])
def test_files_of_others_lost_indexes_and_rewritten_tables(spark, tmp_path, dense):
    folder = str(tmp_path)
    opened = lambda: KeyIndex(spark, f"{folder}/t", f"{folder}/i", NUMBERS, "n", dense=dense, most_parts=2)
    asked = numbers(spark, range(100))
    assert opened().refresh() == [] and found(opened().finished(asked)) == []
    for start in range(0, 50, 10):
        numbers(spark, range(start, start + 10)).coalesce(1).write.mode("append").parquet(f"{folder}/t")
        index = opened()
        # Only what another writer has added is read, also after additions were merged.
        assert len(index.refresh()) == 1 and index.refresh() == []
        assert found(index.finished(asked)) == [(k,) for k in range(start + 10)]
    assert len(opened().parts) <= 3
    # An addition that never got its note does not count.
    (tmp_path / "i" / "999999-left" / "bits").mkdir(parents=True)
    assert found(opened().finished(asked)) == [(k,) for k in range(50)]
    shutil.rmtree(tmp_path / "i")
    index = opened()
    assert len(index.refresh()) == 5 and found(index.finished(asked)) == [(k,) for k in range(50)]
    numbers(spark, range(7)).write.mode("overwrite").parquet(f"{folder}/t")
    index = opened()
    index.refresh()
    assert found(index.finished(asked)) == [(k,) for k in range(7)]


def scanned(df) -> int:
    """Bytes of the file parts that a query's scans read, from their own metrics."""
    df.collect()
    total, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        plan = open_.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(plan.executedPlan())
            continue
        if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            open_.append(plan.plan())
        if name.startswith("Scan parquet"):
            total += plan.metrics().apply("filesSize").value()
        children = plan.children()
        open_ += [children.apply(k) for k in range(children.size())]
    return total


def test_a_batch_reads_as_much_of_a_growing_target_as_of_a_small_one(spark, tmp_path):
    folder, read = str(tmp_path), []
    index = KeyIndex(spark, f"{folder}/t", f"{folder}/i", NUMBERS, "n", dense=True, most_parts=3)
    for batch in range(8):
        rows = numbers(spark, range(batch * 40_000, batch * 40_000 + 500)).withColumn("v", F.repeat("v", 50))
        new = index.refresh()
        by_keys = sum((tmp_path / "t" / name.rsplit("/", 1)[1]).stat().st_size for name in new)
        finished = index.finished(rows)
        read.append(by_keys + scanned(finished))
        assert finished.count() == 0
        append_new(rows.coalesce(1), f"{folder}/t", NUMBERS, "n", index=index)
        append_new(rows.coalesce(1), f"{folder}/t", NUMBERS, "n", index=index)
    table = spark.read.parquet(f"{folder}/t")
    assert table.count() == 8 * 500 == table.select("n").distinct().count()
    # The first batch finds no target, the others one more batch each.
    assert max(read[2:]) <= 1.5 * min(read[2:])
