from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from helpers import ODD, odd_documents
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatloom.llm import packing, tokens
from chatloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def whole_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()


def test_the_query_equals_plain_encoding_on_the_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, start = [], 0
    for doc in docs:
        ids = whole_ids(tokenizer, doc["text"])
        want.append((doc["doc_id"], start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    found = QUERIES["op11_token_files"](spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in found) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_ranks_round_trip(ranks):
    control, data = tokens.pack_ranks(np.array(ranks, dtype="<u4"))
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, -(-r.bit_length() // 8)) for r in ranks)
    assert tokens.unpack_ranks(control, data, len(ranks)).tolist() == ranks


def read_back(spark, path):
    rows = tokens.read_tokens(spark, path).collect()
    return sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in rows), key=lambda r: r[0])


def assert_in_order(found, want):
    """Null ids first, ids ascending, gapless, the ids' own order free within one document id."""
    assert [r[1] for r in found] == sorted((w[0] for w in want), key=lambda i: (i is not None, i or 0))
    assert [r[0] for r in found] == np.concatenate([[0], np.cumsum([r[2] for r in found])])[:-1].tolist()
    assert sorted(((r[1] is not None, r[1] or 0), r[3]) for r in found) == sorted(((i is not None, i or 0), x) for i, x in want)
    assert all(len(r[3]) == 4 * r[2] for r in found)


@pytest.mark.parametrize("block", [1 << 18, 64, 1])
def test_odd_rows_and_blocks_of_any_size(spark, tokenizer, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_IDS", block)
    rows = [(i, (t[:500] if t and block == 1 else t), *rest) for i, t, *rest in ODD]
    tokens.write_tokens(odd_documents(spark, rows), f"file://{tmp_path}/t")
    assert_in_order(read_back(spark, f"file://{tmp_path}/t"), [(r[0], whole_ids(tokenizer, r[1])) for r in rows])


def test_one_id_with_all_rows_is_spread_over_files(spark, tokenizer, tmp_path):
    same = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same words").alias("text"))
    tokens.write_tokens(same, f"file://{tmp_path}/t")
    manifest = json.loads((tmp_path / "t" / "manifest.json").read_text())
    assert len(manifest["files"]) > 1 and max(f["documents"] for f in manifest["files"]) < 2000
    assert_in_order(read_back(spark, f"file://{tmp_path}/t"), [(None, whole_ids(tokenizer, "the same words"))] * 4000)


def test_an_empty_table_has_no_files(spark, tmp_path):
    tokens.write_tokens(odd_documents(spark, []), f"file://{tmp_path}/t")
    assert json.loads((tmp_path / "t" / "manifest.json").read_text())["files"] == []
    assert read_back(spark, f"file://{tmp_path}/t") == []


def test_frequent_ids_take_one_byte(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    tokens.write_tokens(docs, f"file://{tmp_path}/t")
    manifest = json.loads((tmp_path / "t" / "manifest.json").read_text())
    size = sum((tmp_path / "t" / f["name"]).stat().st_size for f in manifest["files"])
    assert size < 1.75 * manifest["ids"] + 40 * docs.count()


def test_files_of_lost_tasks_are_not_read(spark, tokenizer, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id BIGINT, text STRING")
    tokens.write_tokens(docs, f"file://{tmp_path}/t")
    (tmp_path / "t" / "ids-left.bin").write_bytes(b"half a file")
    assert [r[1] for r in read_back(spark, f"file://{tmp_path}/t")] == [1, 2]


def test_the_chunk_cache_forgets_by_generations(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_CHUNKS", 3)
    encode = packing.ChunkEncoder(packing.tokenizer_path())
    texts = ["one two, three four five one two", "Ünïted ONE two; l'été 12x", "six one seven two eight"] * 2
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encode(texts) == want
