from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from helpers import DOCUMENTS, odd_documents
from pyspark.sql import functions as F

from chatloom.llm import boosting, language, toxicity
from chatloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def test_trees_learn_a_rule_and_equal_their_column(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(float)
    trees = boosting.fit(x, y, rounds=20)
    margin = trees.margin(x)
    assert ((margin > 0) == (y == 1)).mean() > 0.97
    df = spark.createDataFrame([[float(v) for v in row] for row in x[:50]], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = [r[0] for r in df.select(trees.column([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert np.allclose(sorted(got), sorted(margin[:50]))


def test_isotonic_is_monotone_and_pools():
    curve = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(curve.value) == [0.0, 0.5, 1.0] and list(curve.at) == [1.0, 2.5, 4.0]
    assert (np.diff(curve(np.linspace(-3, 9, 50))) > 0).all()


def test_trees_without_two_classes():
    trees = boosting.fit(np.zeros((5, 2)), np.ones(5))
    assert np.isfinite(trees.margin(np.zeros((3, 2)))).all()
    assert len(boosting.fit(np.zeros((0, 2)), np.zeros(0)).margin(np.zeros((2, 2)))) == 2


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    judged = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic = [s for y, s, _ in judged if y]
    clean = [s for y, s, _ in judged if not y]
    auc = np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in toxic])
    assert auc > 0.85
    assert np.mean([p for y, _, p in judged if not y]) < 0.01
    assert np.mean([p for y, _, p in judged if y]) > 0.7


def test_toxicity_ignores_labels_that_are_held_out(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert one.lexicon == two.lexicon and (one.trees.leaf == two.trees.leaf).all()


def test_scores_equal_a_plain_reading_of_the_trees(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))

    def plain(text):
        values = list(toxicity._features(text or "", model.lexicon))
        total = model.trees.base
        for feature, threshold, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf):
            node = 0
            for _ in range(3):
                node = 2 * node + (2 if values[feature[node]] > threshold[node] else 1)
            total += leaf[node - 7]
        at, value = list(model.calibration.at), list(model.calibration.value)
        if total <= at[0] or total >= at[-1]:
            known = value[0] if total <= at[0] else value[-1]
        else:
            k = next(k for k in range(len(at)) if at[k + 1] >= total)
            known = value[k] + (value[k + 1] - value[k]) * (total - at[k]) / (at[k + 1] - at[k])
        return min(1.0, max(0.0, 0.99 * known + 0.01 / (1 + np.exp(-max(-40, min(40, total))))))

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == len(texts)
    assert all(r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-9) for r in scores)


def test_a_label_on_a_repeated_row_teaches_once(spark):
    docs = spark.createDataFrame([(1, "a nice text")] * 500 + [(2, "you are an idiot")], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id BIGINT, toxic INT")
    once = toxicity.learn(docs.distinct(), labels)
    many = toxicity.learn(docs, labels)
    assert once.lexicon == many.lexicon and once.trees.base == many.trees.base


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (2, None), (99, 1)], "doc_id BIGINT, toxic INT")
    model = toxicity.learn(docs, labels)
    scores = toxicity.score(docs, model).collect()
    assert len(scores) == 10 and all(0 <= r["score"] <= 1 for r in scores)
    kept = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.count() == 10 and kept.filter("score = 'own score'").count() == 10
    empty = spark.createDataFrame([], DOCUMENTS)
    assert toxicity.drop_toxic(empty, labels.limit(0)).collect() == []


def test_languages_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, DATA).collect()
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in rows)
    right = [truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(right) > 0.98


def test_languages_equal_one_compression_per_language_and_block(spark):
    import zstandard

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    dictionaries = language.learn(docs)

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und"
        data = "".join(c if c.isalpha() else " " for c in text.lower())
        data = " ".join(data.split(" ")) if "  " not in data else __import__("re").sub(" +", " ", data)
        data = data.encode()
        sizes = []
        for name, content in dictionaries.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=language.LEVEL)
            size = 0
            for at in range(0, len(data), language.BLOCK_BYTES):
                one = zstandard.ZstdCompressor(dict_data=shared, level=language.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
                size += len(one.compress(data[at:at + language.BLOCK_BYTES]))
            sizes.append((size, len(sizes), name))
        return min(sizes)[2]

    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = language.classify(docs, dictionaries).collect()
    assert len(rows) == len(texts)
    assert [r["doc_id"] for r in rows if r["best"] != plain(texts[r["doc_id"]])] == []


def test_languages_ignore_what_is_held_out(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    turned = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language.learn(docs) == language.learn(turned)


def test_a_few_huge_documents_fill_no_dictionary_alone(spark):
    """A language of three long texts gets a dictionary, and no text fills one alone."""
    short = [(k, f"the quick brown fox number {'abcdefghij'[k % 10]} jumps over lazy dogs " * 8, "en") for k in range(3000)]
    huge = [(10_000 + k, "el rápido zorro marrón salta sobre el perro perezoso " * 40_000, "es") for k in range(8)]
    docs = spark.createDataFrame(short + huge, "doc_id BIGINT, text STRING, lang STRING")
    found = language.learn(docs)
    assert set(found) == {"en", "es"} and len(found["es"]) > 10_000 and len(found["en"]) > 50_000
    assert max(map(len, found["es"].split(b"\n"))) <= 2 * 4096


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = language.classify(docs, {"en": b"the same short text of words", "es": "ñ el año".encode()}).collect()
    assert len(rows) == 10
    assert {r["best"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert {r["best"] for r in rows if r["doc_id"] == 6} == {"en"}
    assert {r["best"] for r in language.classify(docs, {}).collect()} == {"und"}
    assert language.learn(spark.createDataFrame([], DOCUMENTS)) == {}
    assert language.classify(spark.createDataFrame([], DOCUMENTS), {"en": b"x"}).collect() == []


def test_a_narrow_margin_is_rejected(spark):
    both = b"alpha beta gamma delta"
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id BIGINT, text STRING")
    row = language.classify(docs, {"a": both, "b": both}).first()
    assert (row["best"], row["language"], row["score"]) == ("a", "und", 0.5)
