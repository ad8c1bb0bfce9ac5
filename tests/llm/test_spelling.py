from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_DIR
from helpers import odd_documents
from hypothesis import given, settings, strategies as st

from chatloom.llm import spelling
from chatloom.llm.queries import QUERIES


def plain_counts(rows, slip_every=199, least=5):
    counted = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            hashed = zlib.crc32(f"{'' if id is None else id}:{word}".encode())
            if slip_every and hashed % slip_every == 0:
                place = hashed % len(word)
                word = word[:place] + word[place + 1:]
            counted[word] += 1
    return {w: n for w, n in counted.items() if len(w) >= 6 and n >= least}


def plain_variants(words, ratio=5):
    """By the words that one deleted letter leaves: (form, root, n, n_near, form_n)."""
    left = {}
    for word in words:
        for k in range(len(word)):
            left.setdefault((k, word[:k] + word[k + 1:]), []).append(word)
    near = {word: set() for word in words}
    for word in words:
        for k in range(len(word)):
            short = word[:k] + word[k + 1:]
            near[word].update(left[k, short])
            if short in words:
                near[word].add(short)
                near[short].add(word)
        near[word].discard(word)
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= ratio * words[word] else None
    found = {}
    for word in words:
        root = word
        while form[root]:
            root = form[root]
        found[word] = (form[word], root, words[word], len(near[word]), words.get(form[word]))
    return found


def reported(df):
    rows = df.collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_the_query_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = plain_variants(plain_counts([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    found = reported(QUERIES["op12_spelling_variants"](spark, SF_DIR))
    assert found == want
    assert any(v[0] for v in found.values()) and any(v[3] for v in found.values())


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word STRING, n BIGINT")


def many_words(count=3000):
    rng = np.random.default_rng(12)
    made = {}
    while len(made) < count:
        word = "".join(rng.choice(list("aeinrstéÀ"), rng.integers(6, 9)))
        made[word] = int(rng.integers(1, 2000))
    return made


@pytest.mark.parametrize("tile, sampled, leaf", [(20_000, 200, 64), (60, 20, 3), (7, 3, 1)])
def test_trees_and_tiles_of_any_size_find_the_same(spark, monkeypatch, tile, sampled, leaf):
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    monkeypatch.setattr(spelling, "SAMPLED_PER_CELL", sampled)
    monkeypatch.setattr(spelling, "LEAF", leaf)
    words = many_words(600 if tile < 20_000 else 3000)
    assert reported(spelling.group_variants(table(spark, words))) == plain_variants(words)


def test_anagrams_beyond_a_tile_are_all_compared(spark, monkeypatch):
    from itertools import permutations

    monkeypatch.setattr(spelling, "TILE_WORDS", 100)
    words = {"".join(p): 5 + k for k, p in enumerate(permutations("abcdef"))}
    words |= {"abcdeg": 9000, "abcdefg": 50_000, "bcdefg": 3}
    assert reported(spelling.group_variants(table(spark, words))) == plain_variants(words)


def test_forms_are_followed_to_the_last(spark):
    chain = {("a" * k + "bcdefghijklmn"): 5 ** k for k in range(12)}
    found = reported(spelling.group_variants(table(spark, chain)))
    assert found == plain_variants(chain)
    assert {v[1] for v in found.values()} == {"a" * 11 + "bcdefghijklmn"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=4, max_size=6), min_size=1, max_size=60, unique=True))
def test_a_tile_finds_what_is_one_edit_apart(words):
    near = {(w, x) for w, v in ((w, near_of(w, words)) for w in words) for x in v}
    for length in {len(w) for w in words}:
        points = [w for w in words if len(w) == length]
        for other in (length, length - 1):
            asked = [w for w in words if len(w) == other]
            if asked:
                q, p = spelling.Tile(points).near(asked)
                assert sorted((asked[i], points[j]) for i, j in zip(q, p)) == sorted(
                    (a, b) for a, b in near if len(a) == other and len(b) == length
                )


def near_of(word, words):
    letters = {c for w in words for c in w}
    made = {word[:k] + word[k + 1:] for k in range(len(word))}
    made |= {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    made |= {word[:k] + c + word[k + 1:] for k in range(len(word)) for c in letters}
    return (made - {word}) & set(words)


def test_long_texts_are_read_whole(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 10)
    text = "short Words, überlängen-Wörter and ÉCLATANTE words; " * 7
    assert list(spelling.runs(text)) == [
        "".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)
    ]
    assert list(spelling.runs("x" * 95)) == ["x" * 95]


def test_odd_rows_and_an_empty_table(spark):
    from helpers import ODD

    counted = {r["word"]: r["n"] for r in spelling.word_counts(odd_documents(spark), least_count=1, slip_every=199).collect()}
    assert counted == plain_counts([r[:2] for r in ODD], least=1)
    assert spelling.spelling_variants(odd_documents(spark, [])).collect() == []
    long = spark.createDataFrame([("ab" * 300_000, 7), ("ab" * 300_000 + "c", 40), ("abcdef", 5)], "word STRING, n BIGINT")
    found = reported(spelling.group_variants(long))
    assert found["ab" * 300_000][0] == "ab" * 300_000 + "c" and found["abcdef"][3] == 0
