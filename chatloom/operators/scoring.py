"""Offline losses over logged token distributions (one row per sequence and position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions.distributions import (
    GEM_BETA, IGNORED_LABEL, token_cross_entropy, token_gem, token_kl,
)


def is_trained(label: str = "label") -> Column:
    return F.col(label) != IGNORED_LABEL


def shift_labels(tokens: DataFrame) -> DataFrame:
    """Each position gets the next position's label; a sequence's last one drops out.

    An equi join on (seq_id, pos) instead of a window per sequence: its keys are
    unique, so one long sequence still spreads over all tasks.
    """
    following = tokens.select("seq_id", (F.col("pos") - 1).alias("pos"), "label")
    return tokens.drop("label").join(following, ["seq_id", "pos"])


def with_reference(tokens: DataFrame, reference: DataFrame) -> DataFrame:
    """Student and reference logits of the same token.

    Vectors of positions that are not trained on, usually the greater part of a
    sequence, do not travel: only the keys of trained tokens meet the reference,
    and masked tokens stay with null vectors, so that sequences keep their rows.
    """
    trained = tokens.filter(is_trained())
    met = trained.join(reference.select("seq_id", "pos", "ref_logits"), ["seq_id", "pos"])
    masked = tokens.filter(~F.coalesce(is_trained(), F.lit(False))).withColumns({
        "logits": F.lit(None).cast(tokens.schema["logits"].dataType),
        "ref_logits": F.lit(None).cast(reference.schema["ref_logits"].dataType),
    })
    return met.unionByName(masked)


def cross_entropy_terms(tokens: DataFrame) -> DataFrame:
    """-log p(label) of trained tokens; labels are used as logged, unshifted."""
    return tokens.filter(is_trained()).withColumn(
        "ce", token_cross_entropy(F.col("logits"), F.col("label"))
    )


def kl_terms(tokens: DataFrame, temperature: float = 1.0) -> DataFrame:
    """KL(student || reference) of trained tokens."""
    return tokens.filter(is_trained()).withColumn(
        "kl", token_kl(F.col("logits"), F.col("ref_logits"), temperature)
    )


def gem_terms(
    tokens: DataFrame, beta: float = GEM_BETA, weights: str = "logsigmoid"
) -> DataFrame:
    """Entropy-regularised terms against the shifted labels."""
    return shift_labels(tokens).filter(is_trained()).withColumn(
        "gem", token_gem(F.col("logits"), F.col("label"), beta, weights)
    )


def gem_loss(
    tokens: DataFrame, *by: str, num_items: float | None = None,
    beta: float = GEM_BETA, weights: str = "logsigmoid",
) -> DataFrame:
    """Sum over ``num_items`` when given, else the mean."""
    terms = gem_terms(tokens, beta, weights)
    loss = F.avg("gem") if num_items is None else F.sum("gem") / F.lit(float(num_items))
    return terms.groupBy(*by).agg(loss.alias("gem_loss"))


def combined_loss(
    tokens: DataFrame, *by: str, kl_coef: float = 0.0, step: int = 0,
    kl_start_step: int = 0, temperature: float = 1.0,
) -> DataFrame:
    """Masked mean cross-entropy plus ``kl_coef`` times the masked mean KL.

    KL counts only for a positive coefficient from ``kl_start_step`` on; before
    that the reference logits are not read. Without a trained token the
    cross-entropy is null and the KL is 0.
    """
    trained = is_trained()
    seen = F.when(trained, F.col("logits"))
    scored = tokens.withColumn("_ce", token_cross_entropy(seen, F.col("label")))
    if kl_coef > 0.0 and step >= kl_start_step:
        scored = scored.withColumn("_kl", token_kl(seen, F.col("ref_logits"), temperature))
    else:
        scored, kl_coef = scored.withColumn("_kl", F.lit(0.0)), 0.0
    mean_kl = F.coalesce(F.sum("_kl"), F.lit(0.0)) / F.greatest(F.count_if(trained), F.lit(1))
    return scored.groupBy(*by).agg(
        F.count_if(trained).alias("trained_tokens"),
        F.avg("_ce").alias("loss_ce"),
        mean_kl.alias("loss_kl"),
    ).withColumn("loss", F.col("loss_ce") + F.lit(kl_coef) * F.col("loss_kl"))


def align_vectors(student: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference table resized to the student's ids; new ids copy the student's vector."""
    known = reference.select("token_id", F.col("vector").alias("_ref"))
    joined = student.select("token_id", F.col("vector").alias("_stu")).join(known, "token_id", "left")
    return joined.select(
        "token_id",
        F.coalesce("_ref", "_stu").alias("vector"),
        F.col("_ref").isNull().alias("copied_from_student"),
    )
