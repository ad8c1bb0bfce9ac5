from __future__ import annotations

from conftest import SF_DIR
from helpers import DOCUMENTS, odd_documents
from pyspark.sql import functions as F

from chatloom.llm import mixing


def water_fill(sizes: dict) -> dict:
    """Targets by the rule as worded: cap, reshare by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_reshare_what_a_small_source_cannot_give(spark):
    sizes = {"b": 4, None: 1000, "a": 100, "c": 900, "d": 10, "É": 2}
    table = spark.createDataFrame(list(sizes.items()), "source STRING, size BIGINT")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_words_follow_the_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        "*", F.lit(1).alias("taken"), F.lit("x").alias("_place")
    )
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def test_the_schedule_is_near_the_weights_everywhere(spark):
    sources = spark.createDataFrame([(0, 600), (1, 300), (2, 100)], "source_no INT, _words BIGINT")
    rows = sorted(mixing.schedule(sources, 1).collect())
    assert len(rows) == 1000
    for stretch in range(100, 1000, 100):
        first = [r["source_no"] for r in rows if r["slot"] < stretch]
        assert all(abs(first.count(k) - share * stretch) <= 6 for k, share in enumerate((0.6, 0.3, 0.1)))
    for k, count in enumerate((600, 300, 100)):
        assert sorted(r["block"] for r in rows if r["source_no"] == k) == list(range(count))


def test_documents_are_repeated_as_often_as_taken(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("_row", F.lit("own"))
    want = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.mix(docs).collect() if r["taken"]}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")).collect():
        got[r["doc_id"], r["source"]] = got.get((r["doc_id"], r["source"]), 0) + r["n"]
    assert got == want


def test_odd_rows(spark):
    rows = mixing.mix(odd_documents(spark), block_words=7).collect()
    assert len(rows) == 10
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    mixed = mixing.mix_documents(odd_documents(spark), block_words=7)
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)
    assert mixed.filter("outcome <> 'own outcome'").count() == 0
    empty = spark.createDataFrame([], DOCUMENTS)
    assert mixing.mix(empty).collect() == [] and mixing.mix_documents(empty).collect() == []
