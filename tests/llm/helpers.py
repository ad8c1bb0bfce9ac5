"""Odd rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import functions as F

DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
LONG = " ".join(f"word{i} of, a very long text\n" for i in range(8000))

ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\n ", "en", None, 4),
    (4, LONG, "en", "a", len(LONG)),
    (5, "the same short text of nine words in all", "en", "b", 40),
    (6, "the same short text of nine words in all", "en", "b", 40),
    (6, "the same short text of nine words in all", "en", "b", 40),  # a repeated row
    (None, "a row without a number, mail me@example.com", None, "b", 43),
    (None, None, None, None, None),
    (7, "é🙂 ñ 12 +49 (30) 123 45 67 x", "es", "c", None),
]

# Names that the operators use themselves.
CLASHING = (
    "_id", "_text", "_t", "_row", "_bucket", "_salt", "size", "start", "score", "spans", "node", "piece",
    "template", "pos", "label", "toxic", "_own", "base", "taken", "_lines", "_drops", "outcome",
)


def odd_documents(spark, rows=None):
    df = spark.createDataFrame(ODD if rows is None else rows, DOCUMENTS)
    return df.select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHING])


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)
