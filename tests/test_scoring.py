from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.functions.distributions import token_gem
from chatloom.operators import cutlosses, scoring

TOKENS = "seq_id INT, pos INT, label INT, logits ARRAY<FLOAT>, ref_logits ARRAY<FLOAT>"


def data(seqs=5, length=6, vocab=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for seq in range(seqs):
        for pos in range(length):
            ignored = seq == 4 or rng.random() < 0.3
            rows.append((seq, pos, -100 if ignored else int(rng.integers(vocab)),
                         [float(v) for v in np.float32(rng.normal(size=vocab) * 3)],
                         [float(v) for v in np.float32(rng.normal(size=vocab) * 3)]))
    return rows


def softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def test_cross_entropy_and_kl(spark):
    rows = data()
    df = spark.createDataFrame(rows, TOKENS)
    ce = {(r["seq_id"], r["pos"]): r["ce"] for r in scoring.cross_entropy_terms(df).collect()}
    kl = {(r["seq_id"], r["pos"]): r["kl"] for r in scoring.kl_terms(df, 2.0).collect()}
    trained = [r for r in rows if r[2] != -100]
    assert set(ce) == set(kl) == {(r[0], r[1]) for r in trained}
    for seq, pos, label, logits, ref in trained:
        p, q = softmax(np.array(logits) / 2), softmax(np.array(ref) / 2)
        assert ce[seq, pos] == pytest.approx(-np.log(softmax(logits)[label]))
        assert kl[seq, pos] == pytest.approx((p * np.log(p / q)).sum())


@pytest.mark.parametrize("weights", ["linear", "logsigmoid"])
@pytest.mark.parametrize("num_items", [None, 10])
def test_gem_loss(spark, weights, num_items):
    rows = data()
    got = scoring.gem_loss(spark.createDataFrame(rows, TOKENS), num_items=num_items, weights=weights)
    labels = {(r[0], r[1]): r[2] for r in rows}
    terms = []
    for seq, pos, _, logits, _ in rows:
        label = labels.get((seq, pos + 1), -100)
        if label == -100:
            continue
        x = np.array(logits)
        p, q = softmax(x), softmax(x / 0.7)
        w = 1.0 if weights == "linear" else 1 / (1 + np.exp(-0.01 * (x - x[label])))
        terms.append(-(q * w * np.log(p[label] / p)).sum())
    want = np.mean(terms) if num_items is None else np.sum(terms) / num_items
    assert got.first()[0] == pytest.approx(want)


def test_unknown_weights_raise():
    with pytest.raises(ValueError):
        token_gem(F.lit(None), F.lit(None), weights="square")


def test_combined_loss(spark):
    df = spark.createDataFrame(data(), TOKENS)
    rows = {r["seq_id"]: r for r in scoring.combined_loss(df, "seq_id", kl_coef=0.5).collect()}
    assert rows[4]["trained_tokens"] == 0 and rows[4]["loss_ce"] is None and rows[4]["loss_kl"] == 0
    for seq in range(4):
        assert rows[seq]["loss"] == pytest.approx(rows[seq]["loss_ce"] + 0.5 * rows[seq]["loss_kl"])
        assert rows[seq]["loss_kl"] > 0
    early = scoring.combined_loss(df, kl_coef=0.5, step=3, kl_start_step=4).first()
    assert early["loss"] == early["loss_ce"] and early["loss_kl"] == 0
    unread = scoring.combined_loss(df, kl_coef=0.0)
    assert "ref_logits" not in unread._jdf.queryExecution().optimizedPlan().toString().split("Project")[1]


def test_align_vectors(spark):
    student = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "token_id INT, vector ARRAY<FLOAT>")
    reference = spark.createDataFrame([(i, [-float(i)]) for i in (0, 1, 2, 9)], "token_id INT, vector ARRAY<FLOAT>")
    got = {r["token_id"]: (r["vector"], r["copied_from_student"]) for r in scoring.align_vectors(student, reference).collect()}
    assert got == {0: ([0.0], False), 1: ([-1.0], False), 2: ([-2.0], False), 3: ([3.0], True), 4: ([4.0], True)}


def test_shift_labels_drops_the_last_position(spark):
    df = spark.createDataFrame(data(2, 3), TOKENS)
    labels = {(r["seq_id"], r["pos"]): r["label"] for r in df.collect()}
    got = {(r["seq_id"], r["pos"]): r["label"] for r in scoring.shift_labels(df).collect()}
    assert got == {(s, p): labels[s, p + 1] for s in range(2) for p in range(2)}


@pytest.mark.parametrize("size", [1, 2, 4, 9, 50])
def test_losses_of_cut_vectors_equal_those_of_whole_ones(spark, size):
    rows = data() + [(7, 0, 99, [1.0, 2.0], [1.0, 2.0]), (7, 1, None, [1.0, 2.0], [1.0, 2.0]), (8, 0, 0, None, None), (8, 1, 1, [1e4, -1e4, 0.0], [0.0, 1e4, 3.0])]
    df = spark.createDataFrame(rows, TOKENS)
    cut = cutlosses.cut_vectors(df, size, "logits", "ref_logits")
    assert cut.agg(F.max(F.size("logits"))).first()[0] == min(size, 9)

    def same(one, other, *keys):
        one, other = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (one, other))
        assert set(one) == set(other)
        for key, row in one.items():
            for name, value in row.items():
                assert other[key][name] == (value if value is None else pytest.approx(value, rel=1e-6, abs=1e-9))

    token = ("seq_id", "pos")
    same(scoring.cross_entropy_terms(df).select(*token, "ce"), cutlosses.cut_cross_entropy_terms(cut), *token)
    same(scoring.kl_terms(df, 2.0).select(*token, "kl"), cutlosses.cut_kl_terms(cut, 2.0), *token)
    for weights in ("linear", "logsigmoid"):
        same(scoring.gem_terms(df, weights=weights).select(*token, "gem"), cutlosses.cut_gem_terms(cut, weights=weights), *token)
    for options in ({"kl_coef": 0.3}, {"kl_coef": 0.3, "kl_start_step": 5}, {}):
        same(scoring.combined_loss(df, "seq_id", **options), cutlosses.cut_combined_loss(cut, "seq_id", **options), "seq_id")
    same(scoring.gem_loss(df, num_items=10), cutlosses.cut_gem_loss(cut, num_items=10))


def test_cut_vectors_do_not_move(spark):
    """Numbers are made where a piece stands; what is shuffled has no arrays."""
    cut = cutlosses.cut_vectors(spark.createDataFrame(data(), TOKENS), 3, "logits", "ref_logits")
    plan = cutlosses.cut_combined_loss(cut, "seq_id", kl_coef=0.3)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    for part in plan.split("Exchange hashpartitioning(")[1:]:
        assert "logits" not in part.split("\n")[0]
