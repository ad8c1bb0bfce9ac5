"""Evaluation prompts, passes, grading of recorded runs, and pass rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import problems as rules
from chatloom.functions.chat import two_turn_prompt
from chatloom.functions.text import lenient_code, outputs_match
from chatloom.functions.tokens import TokenCounter, count_tokens


def with_user_prompt(problems: DataFrame, out: str = "user_prompt") -> DataFrame:
    return problems.withColumn(out, rules.problem_prompt(
        F.col("title"), F.col("description"), F.col("statement"),
        F.col("input_format"), F.col("output_format"), F.col("examples"),
    ))


def with_chat_prompt(df: DataFrame, system: Column, user: str = "user_prompt", out: str = "prompt"):
    return df.withColumn(out, two_turn_prompt(system, F.col(user)))


def with_time_limit(problems: DataFrame, out: str = "total_time_limit") -> DataFrame:
    limit = rules.total_time_limit(F.col("time_limit"), F.col("testset_size"))
    return problems.withColumn(out, limit)


def repeat_passes(prompts: DataFrame, passes: int) -> DataFrame:
    """Each prompt ``passes`` times, numbered from 1."""
    if passes < 1:
        return prompts.withColumn("pass_idx", F.lit(1)).filter(F.lit(False))
    numbers = F.sequence(F.lit(1), F.lit(passes))
    return prompts.withColumn("pass_idx", F.explode(numbers))


def evaluable(problems: DataFrame) -> DataFrame:
    return problems.filter(rules.has_example(F.col("examples")))


def grade(runs: DataFrame, problems: DataFrame) -> DataFrame:
    """Runs of evaluable problems with ``ok``.

    One problem may own a large share of the runs; only the expected text rides
    along the join, whose hot partitions AQE splits.
    """
    expected = evaluable(problems).select(
        "id", rules.first_example(F.col("examples"))["output"].alias("_expected")
    )
    graded = runs.join(expected, "id")
    return graded.withColumn("ok", outputs_match(F.col("stdout"), F.col("_expected"))).drop("_expected")


def solved_by_any_pass(graded: DataFrame, *keys: str) -> DataFrame:
    return graded.groupBy(*(keys or ("id",))).agg(F.bool_or("ok").alias("solved"))


def problem_outcomes(
    problems: DataFrame,
    runs: DataFrame,
    generations: DataFrame,
    run_key: str | None = None,
    counter: TokenCounter = count_tokens,
) -> DataFrame:
    """One row per problem: evaluable, solved, new tokens of all its passes.

    With a ``run_key`` one row per run and problem; a run covers the problems it
    has generations of.
    """
    keys = ["id"] if run_key is None else [run_key, "id"]
    solved = solved_by_any_pass(grade(runs, problems), *keys)
    spent = (
        generations.select(*keys, counter(F.col("generation")).alias("_tok"))
        .groupBy(*keys).agg(F.sum("_tok").alias("new_tokens"))
    )
    base = problems.select("id", rules.has_example(F.col("examples")).alias("evaluable"))
    base = base.join(spent, "id", "left") if run_key is None else spent.join(base, "id")
    return (
        base.join(solved, keys, "left")
        .withColumn("solved", F.coalesce("solved", F.lit(False)))
        .withColumn("new_tokens", F.coalesce("new_tokens", F.lit(0)))
    )


def summarize_outcomes(outcomes: DataFrame, *by: str) -> DataFrame:
    """Totals, pass rate and new tokens per problem (not per generation)."""
    totals = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("problems_total"),
        F.count_if("evaluable").alias("problems_evaluable"),
        F.count_if("solved").alias("solved_on_example"),
        F.sum("new_tokens").alias("_tokens"),
    )
    zero = F.lit(0.0)
    rate = F.try_divide("solved_on_example", "problems_evaluable")
    average = F.try_divide("_tokens", "problems_total")
    return totals.select(
        *by, "problems_total", "problems_evaluable", "solved_on_example",
        F.coalesce(rate, zero).alias("example_pass_rate"),
        F.coalesce(average, zero).alias("avg_new_tokens"),
    )


def with_repair_prompt(failed: DataFrame, out: str = "repair_user") -> DataFrame:
    """Repair request from a failed run, its generation and its problem."""
    example = rules.first_example(F.col("examples"))
    return failed.withColumn(out, rules.repair_prompt(
        F.col("user_prompt"), lenient_code(F.col("generation")),
        example["input"], F.col("stdout"), F.col("stderr"),
    ))
