"""Registry of system prompts by name and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The system texts.
CHAT_DEFAULT_SYSTEM = "You are a helpful competitive programming assistant."

TRAINER_DEFAULT_SYSTEM = "You are a competitive programming assistant."

SUMMARY_SYSTEM = (
    "You are a senior competitive programming mentor. "
    "Given a chain-of-thought for a correct solution, with several reasoning tracks, write a short explanation focusing on the main solution"
    "that captures only the final algorithmic logic and key edge cases. "
    "Only consider the final, correct reasoning trace. Do not include any explanation for the other traces."
    "Do NOT include code, numbered steps, or <think> tags. Plain English only."
)

SOLVE_SYSTEM = (
    "You are Qwen, a coding expert. Given a competition-level coding problem, you need to write a python program to solve it."
    "You may start by outlining your thought process."
    "In the end, please provide the complete code in a code block, enclosed in ```python``` tags."
    "Just output code that solves the problem and prints the output in the required output format."
    "Always output valid, runnable code."
    "Note that the input and output are in the format provided in the problem statement."
    "There will always be multiple test cases."
)

SOLVE_SYSTEM_PREVIOUS = (
    "You are Qwen, a coding expert. Given a competition-level coding problem, you need to write a python program to solve it."
    "You may start by outlining your thought process."
    "In the end, please provide the complete code in a code block, enclosed in ```python``` tags."
    "Just output code that solves the problem and prints the output in the required output format."
    "Always output valid, runnable code. Note that the input and output are in the format provided in the problem statement."
    "There will always be multiple test cases."
    "Do not output any extra functions unnecessary to printing the output."
)

REPAIR_SYSTEM = (
    "You are a senior Python developer. You will be given a program, an input, and the observed output or error. "
    "Return a corrected Python program that fixes the issue while still solving the original problem. "
    "Output only the final Python program, no explanations."
)

REGISTRY = (
    ("solve", "current", SOLVE_SYSTEM),
    ("solve", "previous", SOLVE_SYSTEM_PREVIOUS),
    ("repair", "current", REPAIR_SYSTEM),
    ("summary", "current", SUMMARY_SYSTEM),
    ("chat_default", "current", CHAT_DEFAULT_SYSTEM),
    ("trainer_default", "current", TRAINER_DEFAULT_SYSTEM),
)


def prompt_table(spark: SparkSession) -> DataFrame:
    rows = [
        F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(text).alias("text"))
        for name, version, text in REGISTRY
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def with_system_text(df: DataFrame, name: str, version: str = "version") -> DataFrame:
    """Add ``system_text`` for each row's version; an unknown or null version fails.
    The registry has a fixed handful of rows."""
    texts = prompt_table(df.sparkSession).filter(F.col("name") == name)
    texts = texts.select(F.col("version").alias(version), F.col("text").alias("system_text"))
    joined = df.join(F.broadcast(texts), version, "left")
    unknown = F.concat(F.lit(f"no {name} prompt of version "), F.coalesce(F.col(version), F.lit("null")))
    text = F.coalesce("system_text", F.raise_error(unknown).cast("string"))
    return joined.withColumn("system_text", text)
