"""Evaluation and repair as jobs over tables: prompts, generations, recorded runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions.problems import logged_model_name
from chatloom.functions.text import lenient_code
from chatloom.operators import grading, resume
from chatloom.schemas import EVAL_LOG
from chatloom.sources.prompts import REPAIR_SYSTEM, SOLVE_SYSTEM

# Phases of a recorded run.
FIRST_ATTEMPT = 1
REPAIR_ATTEMPT = 2


def log_rounded(value: Column, digits: int) -> Column:
    """Python's rounding (of the binary value, ties to even), which Spark's differs
    from on ties. For log rows, of which a run has one."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits))

    return rounded(value)


def iso_utc(moment: str) -> Column:
    """ISO time with a Z; the fraction is left out when it is zero."""
    seconds = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(moment, ".SSSSSS")
    return F.concat(seconds, F.when(fraction == ".000000", "").otherwise(fraction), F.lit("Z"))


def pending_prompts(
    problems: DataFrame, done: DataFrame, sample: int, passes: int, *order: str,
    done_keys: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Prompts still to generate: resume first, then the sample, then the passes.

    With the default key a finished id is skipped whatever its number of passes;
    ("id", "pass_idx") asks again for passes that are missing.
    """
    def prompted(rows: DataFrame) -> DataFrame:
        asked = grading.with_time_limit(grading.with_user_prompt(rows))
        return grading.with_chat_prompt(asked, F.lit(SOLVE_SYSTEM))

    if "pass_idx" in done_keys:
        # Passes are matched before the long prompts exist, so only keys go
        # through the joins.
        missing = resume.not_done(grading.repeat_passes(problems.select("id"), passes), done, *done_keys)
        unfinished = problems.join(missing.select("id"), "id", "left_semi")
        chosen = resume.first_rows(unfinished, sample, *order)
        return prompted(resume.not_done(grading.repeat_passes(chosen, passes), done, *done_keys))
    todo = resume.first_rows(resume.not_done(problems, done, *done_keys), sample, *order)
    return grading.repeat_passes(prompted(todo), passes)


def eval_log(
    problems: DataFrame, runs: DataFrame, generations: DataFrame, settings: DataFrame,
    run_key: str = "run_id",
) -> DataFrame:
    """One 15-column row per evaluation run, also for a run without any problem.

    Generations, runs and settings share the run key. ``settings`` has one row per
    run: subset, model_id, checkpoint_path, weights_path, split, temperature,
    top_p, max_new_tokens, passes, started_at, finished_at.
    """
    outcomes = grading.problem_outcomes(problems, runs, generations, run_key)
    counts = ["problems_total", "problems_evaluable", "solved_on_example", "example_pass_rate", "avg_new_tokens"]
    totals = settings.join(grading.summarize_outcomes(outcomes, run_key), run_key, "left").fillna(0, counts)
    elapsed = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    rows = totals.select(
        iso_utc("finished_at").alias("timestamp"),
        logged_model_name(
            F.col("model_id"), F.col("checkpoint_path"), F.col("weights_path")
        ).alias("model_id"),
        "subset", "split",
        F.col("problems_total").alias("sample"),
        "temperature", "top_p", "max_new_tokens", "passes",
        "problems_total", "problems_evaluable", "solved_on_example",
        log_rounded(F.col("example_pass_rate"), 4).alias("example_pass_rate"),
        log_rounded(F.col("avg_new_tokens"), 2).alias("avg_new_tokens"),
        log_rounded(elapsed, 2).alias("elapsed_sec"),
    )
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in EVAL_LOG.fields])


def _attempt(runs: DataFrame, phase: int) -> DataFrame:
    """The single recorded run per problem of one repair phase."""
    return runs.filter((F.col("phase") == phase) & (F.col("pass_idx") == 1))


def repair_requests(problems: DataFrame, generations: DataFrame, runs: DataFrame) -> DataFrame:
    """Repair prompts for evaluable problems whose first attempt failed."""
    first = _attempt(runs, FIRST_ATTEMPT)
    failed = grading.grade(first, problems).filter(~F.col("ok"))
    written = generations.filter("pass_idx = 1").select("id", "generation")
    asked = grading.with_user_prompt(grading.evaluable(problems))
    tried = failed.select("id", "stdout", "stderr").join(asked, "id").join(written, "id")
    requests = grading.with_repair_prompt(tried)
    return grading.with_chat_prompt(requests, F.lit(REPAIR_SYSTEM), "repair_user", "repair_prompt")


def repair_results(problems: DataFrame, runs: DataFrame) -> DataFrame:
    """Per evaluable problem, run or not: right at first, or right only after the repair."""
    both = runs.filter("pass_idx = 1 AND phase IN (1, 2)")
    graded = grading.grade(both, problems)
    flags = graded.groupBy("id").agg(
        F.bool_or(F.when(F.col("phase") == FIRST_ATTEMPT, F.col("ok"))).alias("_first"),
        F.bool_or(F.when(F.col("phase") == REPAIR_ATTEMPT, F.col("ok"))).alias("_second"),
    )
    asked = grading.evaluable(problems).select("id", "title")
    first, second = (F.coalesce(c, F.lit(False)) for c in ("_first", "_second"))
    return asked.join(flags, "id", "left").select(
        "id", "title", first.alias("pass_after_first"), (~first & second).alias("pass_after_repair"),
    )


def repair_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("problems"),
        F.count_if("pass_after_first").alias("solved_at_first"),
        F.count_if("pass_after_repair").alias("solved_by_repair"),
    )


def submitted_code(generations: DataFrame) -> DataFrame:
    """The program each generation hands in."""
    return generations.withColumn("code", lenient_code(F.col("generation")))
