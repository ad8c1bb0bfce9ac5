"""From raw documents to packed training sequences, in five stored stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's documents. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import stages
from chatloom.session import fresh_folder, tune

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("source_mixing", stages.source_mixing),
    ("best_fit_packing", stages.best_fit_packing),
]

# A trained classifier and a tokenizer are beyond SQL; tests/llm checks run()
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stored = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(stored)
        docs = spark.read.parquet(stored)
    return docs
