from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR
from helpers import DOCUMENTS, odd_documents, plain
from pyspark.sql import functions as F

from chatloom.llm import fingerprints, oracle, revisits, templates
from chatloom.llm.queries import QUERIES
from check import rows_of


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(oracle.SQL[name])
    assert got == rows_of([c[0] for c in cursor.description], cursor.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["op2_personal_data", "op7_weighted_fingerprints", "op9_line_templates", "op10_source_mixing"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def words(text):
    return Counter(w for w in re.split(r"[^\w]+|_", text.lower()) if w)


def generalised_jaccard(a, b):
    a, b = words(a), words(b)
    return (a & b).total() / (a | b).total() if a or b else 1.0


def test_fingerprints_estimate_the_jaccard_similarity(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()]
    rows = QUERIES["op7_weighted_fingerprints"](spark, SF_DIR).orderBy("doc_id").collect()
    errors = []
    for k, row in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [generalised_jaccard(text, edited) - row["near_edited"], generalised_jaccard(text, after) - row["near_next"]]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    by_text = {}
    for text, row in zip(texts, rows):
        by_text.setdefault(text, set()).add(row["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())


def test_successors_cross_ranges(spark, conf):
    docs = spark.createDataFrame([(k * 3, f"text number {k}") for k in range(200)], "doc_id BIGINT, text STRING")
    want = None
    for parts in ("1", "7", "64"):
        conf("spark.sql.shuffle.partitions", parts)
        got = plain(fingerprints.neighbour_fingerprints(docs).collect())
        want = want or got
        assert got == want and len(got) == 200


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.neighbour_fingerprints(odd_documents(spark)).collect()
    assert len(rows) == 10
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {(r["n_chars"], r["fingerprint"], r["near_edited"]) for r in empty} == {(0, "", 1.0)}
    twin = [r for r in rows if r["doc_id"] in (5, 6)]
    assert len({r["fingerprint"] for r in twin}) == 1 and max(r["near_next"] for r in twin) == 1.0
    assert fingerprints.neighbour_fingerprints(spark.createDataFrame([], DOCUMENTS)).collect() == []
    single = fingerprints.neighbour_fingerprints(spark.createDataFrame([(4, "a b c")], "doc_id BIGINT, text STRING")).first()
    assert (single["near_edited"], single["near_next"]) == (1.0, 1.0) or single["near_next"] == 1.0


def kept_lines(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    return {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(docs, **options).collect()}


def test_recurring_templates_stay_in_one_document(spark):
    rows = [(k, f"own line number of document {'abcdef'[k]} here\nPosted on 2024-01-0{k} by the editor\nAll rights reserved.") for k in range(6)]
    got = kept_lines(spark, rows)
    assert got[0] == rows[0][1]
    assert all(got[k] == f"own line number of document {'abcdef'[k]} here" for k in range(1, 6)) or all(got[k] == "" for k in range(1, 6))


def test_leaves_generalise_varying_words(spark):
    names = ["ann", "bob", "cem", "dee"]
    rows = [(k, f"Comments posted below by {n} are not checked by our staff at all\nline {n} {n}{n} {n}x own") for k, n in enumerate(names)]
    got = kept_lines(spark, rows)
    assert got[0].startswith("Comments") and all("Comments" not in got[k] for k in (1, 2, 3))
    prose = [(k, f"The old house {a} {b} {c} {d} {a}{b}") for k, (a, b, c, d) in enumerate(["abcd", "efgh", "ijkl", "mnop"])]
    assert kept_lines(spark, prose) == dict(prose)


def test_a_leaf_holds_several_templates(spark):
    hot = "Sign up today for the free weekly letter from us"
    names = ["ann", "bob", "cem", "dee", "eva"]
    rows = [(k, f"{hot}\nown {'abcdefgh'[k]} line") for k in range(8)]
    rows += [(10 + k, f"Sign up today with {n} and friends to win prizes") for k, n in enumerate(names)]
    # Two families of the same weight in one leaf, with eight fields.
    rows += [(20 + k, f"Read more on this {n} page about green trees now") for k, n in enumerate(names)]
    rows += [(30 + k, f"Read more on our {n} site with blue rivers instead") for k, n in enumerate(names)]
    rows += [(40, "Sign up today to hear a very old story told")]
    got = kept_lines(spark, rows)
    assert {k for k, text in got.items() if text} == {*range(8), 10, 20, 30, 40}
    assert all((hot in got[k]) == (k == 0) for k in range(8)) and got[10] == rows[8][1] and got[40] == rows[-1][1]


def test_long_lines_recur_from_two_texts(spark):
    long = " ".join(f"{a}{b}" for a in "abcdefg" for b in "stuvwxyz")
    run = f"{long} but the line goes on"
    rows = [(k, f"{long}\nshort one of two texts") for k in range(5)]  # copies count once
    rows += [(10, f"{long}\nshort one of two texts\nmore"), (11, f"a start of its own {run}"), (12, f"another one {run}")]
    got = kept_lines(spark, rows)
    assert got[0] == rows[0][1] and all(got[k] == "short one of two texts" for k in range(1, 5))
    assert got[10] == "short one of two texts\nmore"
    assert (got[11], got[12]) == (rows[6][1], rows[7][1])  # the unit is the whole line
    assert kept_lines(spark, rows, least_texts_long=3) == dict(rows)


def test_the_sql_follows_the_operator(spark):
    """Families and long lines, which a count of three and usual values alone would keep."""
    names = ["ann", "bob", "cem", "dee", "eva"]
    long = " ".join(f"{a}{b}" for a in "abcdefg" for b in "stuvwxyz")
    rows = [(k, f"Sign up today for the free weekly letter from us\nown {'abcdefgh'[k]} line") for k in range(8)]
    rows += [(10 + k, f"Sign up today with {n} and friends to win prizes") for k, n in enumerate(names)]
    rows += [(20 + k, f"Read more on this {n} page about green trees now") for k, n in enumerate(names)]
    rows += [(30 + k, f"Read more on our {n} site with blue rivers instead") for k, n in enumerate(names)]
    rows += [(40, f"{long}\nfirst text"), (41, f"second text\n{long}"), (42, None), (43, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = plain(templates.drop_recurring_lines(docs, report=True).select("doc_id", "text", "n_lines", "n_dropped").collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = plain(db.execute(oracle.SQL["op9_line_templates"]).fetchall())
    assert got == want
    kept = {r[0]: r[1] for r in want}
    assert kept[41] == "second text" and kept[10] and not any(kept[k] for k in (11, 21, 31))


def test_copies_count_once(spark):
    text = "a line that stands in copies only\nand one more such line here"
    assert set(kept_lines(spark, [(k, text) for k in range(5)]).values()) == {text}


def test_lines_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = templates.drop_recurring_lines(docs)
    assert got.columns == docs.columns and got.count() == 10
    rows = got.collect()
    assert {r["text"] for r in rows if r["doc_id"] == 1} == {None} and {r["text"] for r in rows if r["doc_id"] == 2} == {""}
    assert all(r["_lines"] == "own _lines" for r in rows)
    assert templates.drop_recurring_lines(spark.createDataFrame([], DOCUMENTS)).collect() == []


RECORDS = revisits.RECORD_COLUMNS + ", source_id STRING, extra STRING"


def test_revisits(spark):
    page = {"ETag": "a", "Server": "s", "Content-Type": "t"}
    rows = [
        (1, "http://www.x.org/a/", 10, "response", page, "one"), (2, "https://x.org/a?utm_source=q", 20, "response", page | {"ETag": "b"}, "two"),
        (3, "https://X.org:443/a#top", 30, "revisit", {"etag": "b", "Date": "d", "Server": "new"}, None),
        (4, "https://x.org/a", 15, "revisit", {"ETAG": "b"}, None), (5, "https://x.org/a", 15, "revisit", None, None),
        (6, "https://x.org/a", 5, "revisit", {"etag": "a"}, None), (7, None, 50, "revisit", {"etag": "a"}, None),
        (8, "https://x.org/a", None, "revisit", {"etag": "a"}, None), (9, "https://x.org/a", 20, "revisit", {"etag": "b", "x": None}, None),
        (10, "https://x.org/a?b=2&a=1", 60, "response", None, "ab"), (11, "https://x.org/a?a=1&b=2", 61, "revisit", None, None),
    ]
    docs = spark.createDataFrame([(*r, "own", f"e{r[0]}") for r in rows], RECORDS)
    got = {r["record_id"]: r for r in revisits.resolve_revisits(docs).collect()}
    assert {k: (r["source_id"], r["outcome"], r["page"]) for k, r in got.items()} == {
        1: (None, "full", "one"), 2: (None, "full", "two"), 3: (2, "resolved", "two"), 4: (1, "mismatch", None),
        5: (1, "unverified", None), 6: (None, "unresolved", None), 7: (None, "unresolved", None), 8: (None, "unresolved", None),
        9: (2, "resolved", "two"), 10: (None, "full", "ab"), 11: (10, "unverified", None),
    }
    assert got[3]["headers"] == {"etag": "b", "server": "s", "content-type": "t", "date": "d"}
    assert got[11]["address"] == "https://x.org/a?a=1&b=2" and got[5]["extra"] == "e5"
    assert revisits.resolve_revisits(docs.limit(0)).collect() == []


def test_captures_without_a_kind_stay(spark):
    rows = [(1, "http://x.org/", 1, None, {"A": "b"}, "page"), (2, "http://x.org/", 2, "revisit", None, None)]
    got = plain(revisits.resolve_revisits(spark.createDataFrame(rows, revisits.RECORD_COLUMNS)).select("record_id", "kind", "outcome", "source_id", "page").collect())
    assert got == plain([(1, None, "full", None, "page"), (2, "revisit", "unresolved", None, None)])


def test_a_hot_address_is_cut_by_time(spark, conf):
    conf("spark.sql.shuffle.partitions", "16")
    records = spark.range(2000).select(
        F.col("id").alias("record_id"), F.lit("http://x.org/").alias("url"), (F.col("id") * 3).alias("fetched_at"),
        F.when(F.col("id") % 10 == 0, "response").otherwise("revisit").alias("kind"),
        F.create_map(F.lit("etag"), F.lit("a")).alias("headers"), F.col("id").cast("string").alias("page"),
    )
    rows = revisits.resolve_revisits(records).filter("kind = 'revisit'").collect()
    assert len(rows) == 1800 and all(r["source_id"] == r["record_id"] // 10 * 10 and r["page"] == str(r["source_id"]) for r in rows)
