"""Per-token scores of logged model outputs (logits over a vocabulary).

A real vocabulary has over 100,000 entries per token, where one numpy pass over
an Arrow batch is several times faster than Spark's interpreted array lambdas.
Spark still partitions and aggregates; the functions only turn one vector (or a
pair) into one number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

# Ignored label, temperature and slope of the entropy-regularised loss.
IGNORED_LABEL = -100
GEM_BETA = 0.7
GEM_SLOPE = 0.01
GEM_WEIGHTS = ("linear", "logsigmoid")


def _log_softmax(values: np.ndarray) -> np.ndarray:
    shifted = values - values.max(axis=1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))


def _scored(
    vectors: pd.Series, usable: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> pd.Series:
    """Score the usable rows of a batch, all vectors of one length at a time.

    ``score`` gets the stacked vectors and the rows' numbers. The Arrow batch is
    bounded by bytes, and so is the stack.
    """
    out = np.full(len(vectors), np.nan)
    rows = np.flatnonzero(usable)
    lengths = np.array([len(vectors.iloc[r]) for r in rows], dtype=np.int64)
    for length in np.unique(lengths[lengths > 0]):
        some = rows[lengths == length]
        out[some] = score(_stack(vectors, some), some)
    # Null, not NaN, where there is no score.
    return pd.Series(out, dtype="Float64").mask(~np.isin(np.arange(len(out)), rows))


def _stack(vectors: pd.Series, rows: np.ndarray) -> np.ndarray:
    return np.stack(vectors.to_numpy()[rows]).astype(np.float64)


def _labelled(vectors: pd.Series, label: pd.Series) -> np.ndarray:
    """Rows with a vector and a label inside it."""
    lengths = np.array([-1 if v is None else len(v) for v in vectors])
    known = label.notna().to_numpy()
    value = label.fillna(-1).to_numpy(dtype=np.int64)
    return known & (value >= 0) & (value < lengths)


def token_cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label]; null for an ignored label."""

    @F.pandas_udf("double")
    def score(logits: pd.Series, label: pd.Series) -> pd.Series:
        def entropy(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            chosen = label.to_numpy()[rows].astype(np.int64)
            return -_log_softmax(x)[np.arange(len(rows)), chosen]

        return _scored(logits, _labelled(logits, label), entropy)

    return score(logits, label)


def token_kl(logits: Column, ref_logits: Column, temperature: float = 1.0) -> Column:
    """KL(student || reference) of the tempered distributions."""

    @F.pandas_udf("double")
    def score(logits: pd.Series, ref_logits: pd.Series) -> pd.Series:
        def divergence(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            log_p = _log_softmax(x / temperature)
            log_q = _log_softmax(_stack(ref_logits, rows) / temperature)
            return (np.exp(log_p) * (log_p - log_q)).sum(axis=1)

        return _scored(logits, (logits.notna() & ref_logits.notna()).to_numpy(), divergence)

    return score(logits, ref_logits)


def token_gem(
    logits: Column, label: Column, beta: float = GEM_BETA, weights: str = "logsigmoid"
) -> Column:
    """Entropy-regularised term of one token against its label."""
    if weights not in GEM_WEIGHTS:
        raise ValueError(f"weights must be one of {GEM_WEIGHTS}, not {weights!r}")

    @F.pandas_udf("double")
    def score(logits: pd.Series, label: pd.Series) -> pd.Series:
        def term(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
            at = (np.arange(len(rows)), label.to_numpy()[rows].astype(np.int64))
            log_p, q = _log_softmax(x), np.exp(_log_softmax(x / beta))
            if weights == "logsigmoid":
                q = q / (1.0 + np.exp(-GEM_SLOPE * (x - x[at][:, None])))
            return (q * (log_p - log_p[at][:, None])).sum(axis=1)

        return _scored(logits, _labelled(logits, label), term)

    return score(logits, label)
