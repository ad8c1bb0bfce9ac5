"""Prompts and settings derived from one problem row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from chatloom.functions.text import none_if_empty, wide_strip

# Defaults of a problem's limits.
DEFAULT_TIME_LIMIT = 3.0
DEFAULT_TESTSET_SIZE = 10


def first_example(examples: Column) -> Column:
    """First (input, output) example; null when there is none."""
    return F.try_element_at(examples, F.lit(1))


def has_example(examples: Column) -> Column:
    return F.coalesce(F.size(examples) > 0, F.lit(False))


def problem_prompt(
    title: Column,
    description: Column,
    statement: Column,
    input_format: Column,
    output_format: Column,
    examples: Column,
) -> Column:
    """Markdown prompt; empty parts vanish, parts are one blank line apart."""
    text = F.coalesce(none_if_empty(description), none_if_empty(statement))
    example = first_example(examples)

    def headed(heading: str, body: Column) -> Column:
        return F.concat(F.lit(f"\n## {heading}\n\n"), none_if_empty(body))

    def shown(kind: str, body: Column) -> Column:
        clean = wide_strip(F.coalesce(body, F.lit("")))
        return F.concat(F.lit(f"```{kind}\n"), clean, F.lit("\n```"))

    sample = F.when(
        has_example(examples),
        F.concat(
            F.lit("\n## Example\n\n"),
            shown("input", example["input"]),
            F.lit("\n\n"),
            shown("output", example["output"]),
        ),
    )
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), none_if_empty(title)),
        F.concat(F.lit("Problem: "), text),
        headed("Input", input_format),
        headed("Output", output_format),
        sample,
    )


def repair_prompt(
    problem: Column, code: Column, example_input: Column, stdout: Column, stderr: Column
) -> Column:
    r"""Ask for a fix; null parts are empty. The separators are a backslash and an n,
    not newlines."""
    # The wording and layout of the request.
    given = lambda part: F.coalesce(part, F.lit(""))
    return F.concat(
        F.lit(r"Original Problem:\n"), given(problem),
        F.lit(r"\n\nProgram:\n```python\n"), given(code),
        F.lit(r"\n```\n\nInput:\n"), given(example_input),
        F.lit(r"\n\nObserved:\n"), given(stdout),
        F.lit(r"\nErrors:\n"), given(stderr),
        F.lit(r"\n\nPlease return a corrected program."),
    )


def summary_request(think: Column) -> Column:
    return F.concat(
        F.lit("Chain-of-thought:\n"), think, F.lit("\n\nWrite the short explanation now.")
    )


def total_time_limit(time_limit: Column, testset_size: Column) -> Column:
    """Seconds for a whole test set."""
    per_test = F.coalesce(time_limit, F.lit(DEFAULT_TIME_LIMIT))
    return per_test * F.coalesce(testset_size, F.lit(DEFAULT_TESTSET_SIZE))


def logged_model_name(model_id: Column, checkpoint_path: Column, weights_path: Column) -> Column:
    """base+weights, else the checkpoint, else the base; empty paths count as absent."""
    return F.coalesce(
        F.concat(model_id, F.lit("+"), none_if_empty(weights_path)),
        none_if_empty(checkpoint_path),
        model_id,
    )
