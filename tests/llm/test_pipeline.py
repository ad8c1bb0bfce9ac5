from __future__ import annotations

import re
from collections import Counter

from conftest import SF_DIR
from helpers import DOCUMENTS, odd_documents

import corpus_pipeline
from chatloom.llm import oracle, packing, stages
from chatloom.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"
    ]
    assert corpus_pipeline.ORACLE_SQL is None
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(oracle.SQL) <= set(QUERIES)


def test_each_stage_against_a_plain_version(spark):
    """Every decision takes effect, and each stage works on all its predecessor kept."""
    from test_duplicates import brute_documents
    from test_mixing import water_fill

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    scores = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, SF_DIR).collect()}
    clean = stages.toxicity(spark, docs, SF_DIR).cache()
    assert clean.columns == COLUMNS
    assert {r["doc_id"] for r in clean.collect()} == {k for k, s in scores.items() if s < 0.7}

    lines = stages.line_dedup(spark, clean, SF_DIR).cache()
    assert lines.columns == COLUMNS and lines.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    texts_with = Counter(line for t in set(before.values()) for line in set(t.split("\n")))
    masked = lambda line: " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())
    shape = lambda line: (len(line.split()), *masked(line).split()[:3])
    lead, texts_of = {}, Counter()
    for t in set(before.values()):
        own_lines = {masked(line) for line in t.split("\n")}
        texts_of.update(own_lines)
        for line in own_lines:
            lead.setdefault(shape(line), set()).add(line)
    first = {}
    for doc_id in sorted(before):
        for line in before[doc_id].split("\n"):
            first.setdefault(line, doc_id)
    for r in lines.collect():
        assert r["n_chars"] == len(r["text"])
        own = before[r["doc_id"]].split("\n")
        kept = Counter(r["text"].split("\n"))
        for line in own:
            needed = 2 if len(line.split()) >= 50 else 3
            if len(line.split()) >= 3 and texts_with[line] >= needed and first[line] != r["doc_id"]:
                assert not kept[line]
            # A short line stays, and so does the only line of its first words and length.
            if len(line.split()) < 3 or lead[shape(line)] == {masked(line)} and texts_of[masked(line)] < needed:
                assert kept[line] == own.count(line)

    one = stages.near_duplicates(spark, lines, SF_DIR).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in lines.collect())
    assert {r["doc_id"] for r in one.collect()} == {a for a, b, _ in brute_documents(rows) if a == b}

    mixed = stages.source_mixing(spark, one, SF_DIR).cache()
    assert mixed.columns == COLUMNS
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = Counter(), Counter()
    for r in one.collect():
        sizes[r["source"]] += count(r["text"])
    for r in mixed.collect():
        taken[r["source"]] += count(r["text"])
    assert all(abs(taken[s] - t) <= 1 for s, t in water_fill(sizes).items())

    packed = stages.best_fit_packing(spark, mixed, SF_DIR).collect()
    lengths = Counter(r["doc_id"] for r in mixed.collect())
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == lengths
    by_sequence = Counter()
    for r in packed:
        by_sequence[r["sequence_id"]] += r["length"]
    assert max(by_sequence.values()) <= packing.MAX_TOKENS
    for df in (docs, clean, lines, one, mixed):
        df.unpersist()


def test_run_gives_packed_sequences(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())


def test_stages_take_odd_tables(spark):
    docs = odd_documents(spark)
    own = [c for c in docs.columns if c not in COLUMNS]
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR).cache()
        assert {(r[c] == f"own {c}") for r in docs.collect() for c in own} == {True}
        counts.append(docs.count())
    # Nothing is toxic, no line recurs in three texts; of three equal texts one stays.
    assert counts[:3] == [10, 10, 8]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    # Of documents without words the mix takes nothing.
    assert {4, 7} <= {r["doc_id"] for r in packed} and not {1, 2, 3} & {r["doc_id"] for r in packed}


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.collect() == []
