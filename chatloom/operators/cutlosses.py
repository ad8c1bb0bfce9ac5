"""Losses over logged logits whose vocabulary is cut: a token's vector in several rows.

A piece is (seq_id, pos, label, cut_from, logits[, ref_logits]), where ``logits`` are
those of the vocabulary's ids from ``cut_from`` on. It is turned into a few numbers
where it stands: its maximum, sums of exponentials relative to that maximum, and the
label's logit where the piece has it. Numbers of one token are merged like a
log-sum-exp: the maximum of all maxima first, then sums scaled to it. Both steps
are partial aggregates over narrow rows, so no task ever holds a whole vocabulary,
and vectors do not move (but for the entropy-regularised sigmoid weights, which need
the label's logit beside every piece; that logit travels to the pieces).

Results equal those of ``scoring`` on uncut vectors: a label outside the vocabulary
or a missing piece gives a null term; masked tokens count for nothing, but sequences
keep their rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions.distributions import GEM_BETA, GEM_SLOPE, GEM_WEIGHTS
from chatloom.operators.scoring import is_trained

TOKEN = ["seq_id", "pos"]


def cut_vectors(tokens: DataFrame, size: int, *vectors: str) -> DataFrame:
    """Rows with vectors in pieces of at most ``size`` entries, numbered by ``cut_from``."""
    longest = F.greatest(F.lit(1), *[F.coalesce(F.size(v), F.lit(0)) for v in vectors])
    starts = tokens.withColumn("cut_from", F.explode(F.sequence(F.lit(0), longest - 1, F.lit(size))))
    return starts.withColumns({v: F.slice(v, F.col("cut_from") + 1, F.lit(size)) for v in vectors})


def _by_length(vectors: pd.Series, usable: np.ndarray, score: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], names: list[str]) -> pd.DataFrame:
    """Numbers of the usable pieces, all of one length at a time; NaN elsewhere."""
    out = {name: np.full(len(vectors), np.nan) for name in names}
    rows = np.flatnonzero(usable)
    lengths = np.array([len(vectors.iloc[r]) for r in rows], dtype=np.int64)
    for length in np.unique(lengths[lengths > 0]):
        some = rows[lengths == length]
        stacked = np.stack(vectors.to_numpy()[some]).astype(np.float64)
        for name, values in zip(names, score(stacked, some)):
            out[name][some] = values
    return pd.DataFrame(out)


def _chosen(x: np.ndarray, label: pd.Series, first: pd.Series, rows: np.ndarray) -> np.ndarray:
    """The label's logit where a piece has it, else NaN."""
    at = label.to_numpy(dtype=np.float64, na_value=-1)[rows] - first.to_numpy(dtype=np.float64)[rows]
    inside = (at >= 0) & (at < x.shape[1])
    found = np.full(len(rows), np.nan)
    found[inside] = x[np.flatnonzero(inside), at[inside].astype(np.int64)]
    return found


def _numbers(made: Column, pieces: DataFrame, names: list[str], *more: str) -> DataFrame:
    """Keys and a piece's numbers, NaN as null; ``lost`` marks a missing piece."""
    wide = pieces.select(*TOKEN, *more, made.alias("_n"))
    number = lambda name: F.when(~F.isnan(f"_n.{name}"), F.col(f"_n.{name}")).alias(name)
    return wide.select(*TOKEN, *more, *[number(name) for name in names]).withColumn("lost", F.col(names[0]).isNull())


def _merged(numbers: DataFrame, tops: dict[str, list[str]], *more: Column) -> DataFrame:
    """One row per token: each maximum, and the sums that are relative to it."""
    highest = numbers.groupBy(*TOKEN).agg(*[F.max(top).alias(f"all_{top}") for top in tops])
    scaled = [
        F.sum(F.col(name) * F.exp(F.col(top) - F.col(f"all_{top}"))).alias(name) for top, sums in tops.items() for name in sums
    ]
    return numbers.join(highest, TOKEN).groupBy(*TOKEN).agg(
        *[F.max(f"all_{top}").alias(top) for top in tops], *scaled, F.bool_or("lost").alias("lost"), *more
    )


def _whole(term: Column) -> Column:
    return F.when(~F.col("lost"), term)


def cut_cross_entropy_terms(pieces: DataFrame) -> DataFrame:
    """(seq_id, pos, ce) of trained tokens."""

    @F.pandas_udf("top double, total double, chosen double")
    def summary(logits: pd.Series, label: pd.Series, first: pd.Series) -> pd.DataFrame:
        def numbers(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
            top = x.max(axis=1)
            return [top, np.exp(x - top[:, None]).sum(axis=1), _chosen(x, label, first, rows)]

        return _by_length(logits, logits.notna().to_numpy(), numbers, ["top", "total", "chosen"])

    trained = pieces.filter(is_trained())
    found = _numbers(summary("logits", "label", "cut_from"), trained, ["top", "total", "chosen"])
    merged = _merged(found, {"top": ["total"]}, F.max("chosen").alias("chosen"))
    return merged.select(*TOKEN, _whole(F.col("top") + F.ln("total") - F.col("chosen")).alias("ce"))


def cut_kl_terms(pieces: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(seq_id, pos, kl): KL(student || reference) of trained tokens."""
    names = ["top", "total", "gap", "ref_top", "ref_total"]

    @F.pandas_udf("top double, total double, gap double, ref_top double, ref_total double")
    def summary(logits: pd.Series, ref_logits: pd.Series) -> pd.DataFrame:
        def numbers(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
            x = x / temperature
            y = np.stack(ref_logits.to_numpy()[rows]).astype(np.float64) / temperature
            top, ref_top = x.max(axis=1), y.max(axis=1)
            weight = np.exp(x - top[:, None])
            return [top, weight.sum(axis=1), (weight * (x - y)).sum(axis=1), ref_top, np.exp(y - ref_top[:, None]).sum(axis=1)]

        return _by_length(logits, (logits.notna() & ref_logits.notna()).to_numpy(), numbers, names)

    found = _numbers(summary("logits", "ref_logits"), pieces.filter(is_trained()), names)
    merged = _merged(found, {"top": ["total", "gap"], "ref_top": ["ref_total"]})
    # Sum of p (x - y) from the scaled sums; then the two normalisers.
    kl = F.col("gap") / F.col("total") - F.col("top") - F.ln("total") + F.col("ref_top") + F.ln("ref_total")
    return merged.select(*TOKEN, _whole(kl).alias("kl"))


def _shifted(pieces: DataFrame) -> DataFrame:
    """Each token's pieces with the next position's label."""
    following = pieces.filter("cut_from = 0").select("seq_id", (F.col("pos") - 1).alias("pos"), "label")
    return pieces.drop("label").join(following, TOKEN)


def cut_gem_terms(pieces: DataFrame, beta: float = GEM_BETA, weights: str = "logsigmoid") -> DataFrame:
    """(seq_id, pos, gem): entropy-regularised terms against the shifted labels."""
    if weights not in GEM_WEIGHTS:
        raise ValueError(f"weights must be one of {GEM_WEIGHTS}, not {weights!r}")
    trained = _shifted(pieces).filter(is_trained())

    @F.pandas_udf("double")
    def chosen(logits: pd.Series, label: pd.Series, first: pd.Series) -> pd.Series:
        found = _by_length(logits, logits.notna().to_numpy(), lambda x, rows: [_chosen(x, label, first, rows)], ["chosen"])
        return found["chosen"].astype("Float64").mask(found["chosen"].isna())

    labelled = trained.withColumn("own", chosen("logits", "label", "cut_from")).filter("own IS NOT NULL").select(*TOKEN, "own")

    @F.pandas_udf("top double, total double, pull double")
    def summary(logits: pd.Series, own: pd.Series) -> pd.DataFrame:
        def numbers(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
            gap = x - own.to_numpy(dtype=np.float64)[rows][:, None]
            top = x.max(axis=1) / beta
            weight = np.exp(x / beta - top[:, None])
            pull = weight * gap
            if weights == "logsigmoid":
                pull = pull / (1.0 + np.exp(-GEM_SLOPE * gap))
            return [top, weight.sum(axis=1), pull.sum(axis=1)]

        return _by_length(logits, (logits.notna() & own.notna()).to_numpy(), numbers, ["top", "total", "pull"])

    beside = trained.join(labelled, TOKEN, "left")
    found = _numbers(summary("logits", "own"), beside, ["top", "total", "pull"])
    merged = _merged(found, {"top": ["total", "pull"]})
    return merged.select(*TOKEN, _whole(F.col("pull") / F.col("total")).alias("gem"))


def cut_gem_loss(
    pieces: DataFrame, *by: str, num_items: float | None = None, beta: float = GEM_BETA, weights: str = "logsigmoid",
) -> DataFrame:
    """Sum over ``num_items`` when given, else the mean; ``by`` is among the token's keys."""
    loss = F.avg("gem") if num_items is None else F.sum("gem") / F.lit(float(num_items))
    return cut_gem_terms(pieces, beta, weights).groupBy(*by).agg(loss.alias("gem_loss"))


def cut_combined_loss(
    pieces: DataFrame, *by: str, kl_coef: float = 0.0, step: int = 0, kl_start_step: int = 0, temperature: float = 1.0,
) -> DataFrame:
    """``scoring.combined_loss`` on pieces; ``by`` is among the token's keys."""
    tokens = pieces.filter("cut_from = 0").select(*TOKEN, is_trained().alias("_trained"))
    scored = tokens.join(cut_cross_entropy_terms(pieces), TOKEN, "left")
    if kl_coef > 0.0 and step >= kl_start_step:
        scored = scored.join(cut_kl_terms(pieces, temperature), TOKEN, "left")
    else:
        scored, kl_coef = scored.withColumn("kl", F.lit(0.0)), 0.0
    mean_kl = F.coalesce(F.sum("kl"), F.lit(0.0)) / F.greatest(F.count_if("_trained"), F.lit(1))
    return scored.groupBy(*by).agg(
        F.count_if("_trained").alias("trained_tokens"), F.avg("ce").alias("loss_ce"), mean_kl.alias("loss_kl"),
    ).withColumn("loss", F.col("loss_ce") + F.lit(kl_coef) * F.col("loss_kl"))
