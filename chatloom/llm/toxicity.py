"""Toxicity scores: boosted trees over dense features, calibrated isotonically.

Labels are learned only from rows whose crc32 of the id as text leaves no
remainder 1 by 3, and from a bounded number of them (``most_labels`` per class, in
hash order). The lexicon is counted on these rows by Spark: whole words and word
beginnings that are far more frequent in toxic documents, beside a short fixed
list. Its size is bounded by ``lexicon_size``. One pass over the texts then counts
the features and scores them; texts are read whole.

Defined cases: a null or empty text has all features 0 and gets a score like any
other; null labels and labels without a document are not learned from; several
labels of one id count once each; without two classes every score is the class's
share; an empty table gives no rows; further columns are ignored by ``score``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm import boosting

# Common insults, second-person words of four languages, and
# characters that stand in for letters.
INSULTS = ("clown", "disgusting", "dumb", "fool", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "worthless")
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú tu ti tus usted ustedes vosotros".split())
STAND_INS = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[\w@$!*]+")
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
MARKS = re.compile(r"[!?]")
PUNCTUATION = re.compile(r"[^\w\s]")
DISGUISED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1\1")

BEGINNINGS = (4, 5, 6)
NEAR = 6
FEATURES = (
    "words", "lexicon_density", "lexicon_hits", "lexicon_weight", "strongest", "distinct_hits",
    "disguised_hits", "near_second_person", "second_person", "capitals", "shouted", "marks",
    "punctuation", "disguised", "stretched",
)


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string")) % 3 == 1


def _features(text: str, lexicon: dict[str, float]) -> list[float]:
    low = text.lower()
    words = WORD.findall(low)
    count = len(words)
    if not count:
        return [0.0] * len(FEATURES)
    weight, hits, disguised, kinds = [], [], 0, set()
    get = lexicon.get
    for at, word in enumerate(words):
        found = max(get(word, 0.0), get(word[:4] + "…", 0.0), get(word[:5] + "…", 0.0), get(word[:6] + "…", 0.0))
        if not found and not word.isalpha():
            plain = word.strip("!").translate(STAND_INS).replace("*", "")
            found = max(get(plain, 0.0), get(plain[:5] + "…", 0.0), get(plain[:6] + "…", 0.0))
            disguised += found > 0
        if found:
            weight.append(found)
            hits.append(at)
            kinds.add(word)
    person = [at for at, word in enumerate(words) if word in SECOND_PERSON] if hits else []
    near = 0
    if person:
        after = np.searchsorted(person, hits)
        bounds = np.array([-10**9, *person, 10**9])
        gaps = np.minimum(bounds[after + 1] - hits, np.array(hits) - bounds[after])
        near = int((gaps <= NEAR).sum())
    chars = len(text)
    return [
        np.log1p(count), len(hits) / count, float(len(hits)), sum(weight) / count, max(weight, default=0.0),
        float(len(kinds)), float(disguised), near / count, len(person) / count,
        len(CAPITALS.findall(text)) / chars, len(SHOUTED.findall(text)) / count,
        len(MARKS.findall(text)) / count, len(PUNCTUATION.findall(text)) / chars,
        len(DISGUISED.findall(text)) / count, len(STRETCHED.findall(text)) / count,
    ]


def learned_lexicon(sample: DataFrame, size: int, least_docs: int = 4, least_ratio: float = 8.0) -> dict[str, float]:
    """Words and beginnings with their log ratio of document frequencies.

    ``sample`` has (text, toxic). A beginning ends with an ellipsis.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)))
    long_ = F.filter(words, lambda w: F.length(w) > 3)
    terms = F.array_distinct(F.flatten(F.transform(long_, lambda w: F.array(
        w, *[F.concat(F.substring(w, 1, n), F.lit("…")) for n in BEGINNINGS]
    ))))
    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    toxic, clean = totals["toxic"] or 0, totals["rows"] - (totals["toxic"] or 0)
    if not toxic or not clean:
        return {}
    counts = sample.select("toxic", F.explode(terms).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    ratio = F.log((F.col("a") + 0.5) / toxic / ((F.col("b") + 0.5) / clean))
    rows = (
        counts.filter(F.col("a") >= least_docs).select("term", "a", ratio.alias("weight"))
        .filter(F.col("weight") >= float(np.log(least_ratio)))
        .orderBy(F.desc(F.col("a") * F.col("weight")), "term").limit(size).collect()
    )
    return {row["term"]: float(row["weight"]) for row in rows}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: boosting.Trees
    calibration: boosting.Isotonic


def _matrix(texts, lexicon: dict[str, float]) -> np.ndarray:
    return np.array([_features(text or "", lexicon) for text in texts], dtype=float).reshape(-1, len(FEATURES))


def learn(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic",
    most_labels: int = 5000, lexicon_size: int = 2000,
) -> Model:
    """Fit lexicon, trees and calibration on at most ``most_labels`` rows of each class."""
    usable = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("toxic")).filter(
        F.col("_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("_id"))
    ).distinct()
    by_hash = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    chosen = usable.filter("toxic = 0").orderBy(*by_hash).limit(most_labels).unionByName(
        usable.filter("toxic = 1").orderBy(*by_hash).limit(most_labels)
    )
    # At most twice most_labels rows of two numbers.
    sample = docs.select(F.col(id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(chosen), "_id"
    ).dropDuplicates(["_id", "toxic", "text"])  # a row repeated under one id teaches once
    lexicon = {word: 3.0 for word in INSULTS} | learned_lexicon(sample, lexicon_size)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "_id": batch["_id"].astype(str), "toxic": batch["toxic"],
                "features": list(_matrix(batch["text"], lexicon)),
            })

    rows = sample.mapInPandas(features, "_id string, toxic int, features array<double>").toPandas()
    rows = rows.sort_values(["_id", "toxic"], kind="stable")
    x = np.array(rows["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    y = rows["toxic"].to_numpy(float)
    # Each third is scored by trees that have not seen it; the calibration fits these scores.
    part = np.arange(len(y)) % 3
    margin = np.zeros(len(y))
    for k in range(3):
        margin[part == k] = boosting.fit(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicon, boosting.fit(x, y), boosting.isotonic(margin, y))


def score(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score): the calibrated probability that a document is toxic."""
    rows = docs.select(F.col(id), F.col(text).alias("_text"), *keep)

    @F.pandas_udf("double")
    def calibrated(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = _matrix(texts, model.lexicon)
            yield pd.Series(np.clip(model.calibration(model.trees.margin(x)), 0.0, 1.0))

    return rows.withColumn("score", calibrated("_text")).drop("_text")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **columns) -> DataFrame:
    """The documents whose score is below ``threshold``, all columns unchanged."""
    model = learn(docs, labels, **columns)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(columns.get("text", "text")).alias("_own"))
    scored = score(rows, model, id="_row", text="_own")
    return scored.filter(F.col("score") < threshold).select("_row.*")
