from __future__ import annotations

import hashlib
import re

import pytest
from conftest import SF_DIR
from helpers import DOCUMENTS, ODD, odd_documents

from chatloom.llm import pii
from chatloom.llm.queries import QUERIES

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = {k: [m.span() for m in re.finditer(p, text) if valid(k, m.group())] for k, p in RULES.items()}
    text = ",".join(f"{k}:{a}:{b}" for k, v in spans.items() for a, b in v)
    return [len(v) for v in spans.values()], text


def assert_base(row, text):
    counts, base = brute(text or "")
    assert [row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]] == counts
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(filter(None, base.split(","))) <= set(row["spans"].split(","))


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_base_spans_of_all_documents(spark):
    rows = QUERIES["op2_personal_data"](spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    for row in rows:
        assert_base(row, texts[row["doc_id"]])


TRICKY = [
    "a@b.c_d@e.f a@b..c x@y.z.", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 001.002.003.0004 1.2.3.4567 0.0.0.255",
    "4111 1111 1111 1111, 4111-1111-1111-1112, 41111111111111111111 5 4111111111111111",
    "+1 (988) 555-2485 +1) +12 +123456789012345678 +1 2 3 4 5 6 7 8 9.", "é🙂a@b.cd +33 1 23 45 67 89-",
    "@@a@b@c.d%a+b@c-d.e-f.-", "a" * 3000 + "@" + "b." * 3000 + "c " + "1 " * 4000 + "9" * 3000,
    "x@" + ".y" * 5000, "12 34\n56 " * 900,
]


def test_base_spans_of_tricky_texts(spark, model):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id BIGINT, text STRING")
    for row in pii.find(df, model).collect():
        assert_base(row, TRICKY[row["doc_id"]])


def account(number):
    """A number with valid check digits."""
    body = f"3704 0044 {number:04d} 0130 00"
    rest = int("".join(str(int(c, 36)) for c in body.replace(" ", "") + "DE00")) % 97
    return f"DE{98 - rest:02d} {body}"


def wrong_account(number):
    right = account(number)
    return f"DE{(int(right[2:4]) + 1) % 100:02d}{right[4:]}"


def corpus(count=150):
    """Confirmed data in contexts of their own, and the same forms in others."""
    texts = []
    for i in range(count):
        texts += [
            f"please call +49 30 {1000000 + 7919 * i} today", f"your order 49 30 {2000000 + 7919 * i} has shipped",
            f"do write to {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10] * (i % 4)} (at) example dot com soon", f"please pay to {account(i)} by noon",
            f"the article {wrong_account(i)} is in stock",
        ]
    return list(enumerate(texts))


NEW = {
    "please call 49 30 7654321 today": ("phone", "49 30 7654321"),
    "your order 49 30 7654321 has shipped": None,
    "é do write to bob (at) mail dot org soon": ("email", "bob (at) mail dot org"),
    f"please pay to {account(777)} by noon": ("account", account(777)),
    f"the article {wrong_account(777)} is in stock": None,
}


def decided(spark, model):
    docs = spark.createDataFrame(list(enumerate(NEW)), "doc_id BIGINT, text STRING")
    return [r["spans"] for r in pii.find(docs, model).orderBy("doc_id").collect()]


def wanted():
    return ["" if found is None else f"{found[0]}:{text.index(found[1])}:{text.index(found[1]) + len(found[1])}" for text, found in NEW.items()]


def test_trees_add_what_is_like_confirmed_data(spark):
    """A number that no rule confirms is added where it stands and looks like confirmed
    ones; the same form elsewhere is not."""
    model = pii.learn(spark.createDataFrame(corpus(), "doc_id BIGINT, text STRING"))
    assert decided(spark, model) == wanted()


def test_all_candidates_are_learned_from(spark):
    """15,000 documents with one candidate each, 5,000 of them confirmed: none is left out."""
    docs = spark.range(15_000).selectExpr(
        "id AS doc_id", "concat(if(id % 3 = 0, 'call +49 30 ', 'sent 49 30 '), 1000000 + id, ' now') AS text"
    )
    trees = pii.learn(docs).trees
    assert trees.base == pytest.approx(pii.np.log(5000.5 / 10000.5), abs=1e-12)
    without = [pii.np.exp(t.base) for t in trees.held]  # of two thirds of the rows each
    assert len(without) == pii.FOLDS and all(0.45 < v < 0.55 for v in without)


def test_trees_of_counted_rows_are_those_of_the_rows(spark):
    """The same splits and leaves as from a matrix of all rows, and of those without a fold."""
    rng = pii.np.random.default_rng(3)
    x = pii.np.floor(rng.gamma(2.0, 20.0, size=(600, 4)))
    y = (x[:, 0] + 0.5 * x[:, 2] + rng.normal(size=600) * 8 > 60).astype(float)
    x, y, part = pii.np.r_[x, x[:200]], pii.np.r_[y, y[:200]], pii.np.arange(800) % 2  # some rows twice
    rows = spark.createDataFrame([(f.tolist(), int(p), int(v)) for f, p, v in zip(x, part, y)], "f ARRAY<DOUBLE>, part INT, y INT")
    trees = pii.boosting.fit(pii.boosting.counted(rows), rounds=6, folds=2)
    plain = pii.boosting.fit(x, y, rounds=6)
    assert (trees.feature == plain.feature).all() and pii.np.allclose(trees.margin(x), plain.margin(x), atol=1e-6)
    for k, held in enumerate(trees.held):
        share = (y[part != k].sum() + 0.5) / ((part != k).sum() + 1.0)
        assert held.base == pytest.approx(pii.np.log(share / (1 - share)))
        assert ((held.margin(x) > 0) == (y == 1)).mean() > 0.85


def test_calibration_counts_rows_of_a_margin():
    whole = pii.boosting.isotonic(pii.np.array([1.0, 1, 1, 2, 2]), pii.np.array([0.0, 1, 0, 1, 1]))
    cells = pii.boosting.isotonic(pii.np.array([1.0, 2]), pii.np.array([1.0, 2]), pii.np.array([3.0, 2]))
    assert cells.at.tolist() == [1.0, 2.0] and cells.value.tolist() == [pytest.approx(1 / 3), 1.0]
    assert whole.value[-1] == cells.value[-1]


def test_numbers_that_fail_a_decisive_check_are_no_data(spark):
    """Valid and invalid card numbers in the same surroundings: only the base spans."""
    def card(number):
        body = f"4{number:014d}"
        return next(body + str(k) for k in range(10) if luhn(body + str(k)))

    texts = []
    for i in range(200):
        good = card(7919 * i)
        texts += [f"some words {good} and more", f"some words {good[:-1]}{(int(good[-1]) + 1) % 10} and more"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert all((found[k] == "") == (k % 2 == 1) for k in range(len(texts)))


def test_without_trees_nothing_is_told_apart(spark, monkeypatch):
    flat = pii.boosting.Trees(0.0, pii.np.zeros((0, 7), int), pii.np.zeros((0, 7)), pii.np.zeros((0, 8)))
    monkeypatch.setattr(pii.boosting, "fit", lambda *args, **options: flat)
    model = pii.learn(spark.createDataFrame(corpus(30), "doc_id BIGINT, text STRING"))
    assert decided(spark, model) == [""] * len(NEW)


def test_what_confirms_is_no_feature(spark, model):
    """Two candidates that differ only in what confirms them have the same features."""
    pairs = [("pay to " + account(5), "pay to " + wrong_account(5)), ("call +49 30 1234567", "call 49 30 1234567"),
             ("card 4111 1111 1111 1111", "card 4111 1111 1111 1112")]
    rows = [(2 * k + j, text) for k, pair in enumerate(pairs) for j, text in enumerate(pair)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = pii._with_candidates(pii._with_base(docs, "text", ["doc_id"])).select("doc_id", "_cands").collect()
    cands = {r["doc_id"]: [(c["no"], c["f"]) for c in r["_cands"]] for r in found}
    assert cands[0] == cands[1] and cands[2] == cands[3]
    assert [f[1:] for _, f in cands[4]] == [f[1:] for _, f in cands[5]]


def test_redaction_covers_overlaps(spark, model):
    docs = spark.createDataFrame([(1, "é mail a@b.cd, +4222222222222 x", "own")], "doc_id BIGINT, text STRING, _row STRING")
    row = pii.redact(docs, model).first()
    assert row["text"] == "é mail [EMAIL], [PHONE] x"
    assert row["_row"] == "own"


def test_odd_rows(spark, model):
    rows = pii.find(odd_documents(spark), model).collect()
    assert len(rows) == 10
    texts = {}
    for r in ODD:
        texts.setdefault(r[0], []).append(r[1])
    for row in rows:
        if row["doc_id"] is not None:
            assert_base(row, texts[row["doc_id"]][0])
    assert pii.redact(odd_documents(spark), model).count() == 10
    empty = spark.createDataFrame([], DOCUMENTS)
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []
