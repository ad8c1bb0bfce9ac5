"""Declared schemas of every table the pipelines read or write."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

CHAT_ROWS = T.StructType([
    T.StructField("source_idx", T.LongType()),
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("num_tokens", T.LongType()),
    # Null for a whole chat, else the row's number among the chat's parts.
    T.StructField("part", T.LongType()),
    T.StructField("parts", T.LongType()),
])

CHAT_TURNS = T.StructType([
    T.StructField("source_idx", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])

PREPARED_CHATS = T.StructType([
    T.StructField("messages", T.ArrayType(MESSAGE)),
    T.StructField("language", T.StringType()),
    T.StructField("num_tokens_serialized", T.LongType()),
    T.StructField("source_idx", T.LongType()),
])

EXAMPLE = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

PROBLEMS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("statement", T.StringType()),
    T.StructField("input_format", T.StringType()),
    T.StructField("output_format", T.StringType()),
    T.StructField("examples", T.ArrayType(EXAMPLE)),
    T.StructField("time_limit", T.DoubleType()),
    T.StructField("testset_size", T.LongType()),
])

GENERATIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("generation", T.StringType()),
    T.StructField("pass_idx", T.IntegerType()),
])

RUNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pass_idx", T.IntegerType()),
    T.StructField("phase", T.IntegerType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("rc", T.IntegerType()),
])

REPAIR_RESULTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("pass_after_first", T.BooleanType()),
    T.StructField("pass_after_repair", T.BooleanType()),
])

# The columns of the evaluation log.
EVAL_LOG = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("model_id", T.StringType()),
    T.StructField("subset", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("sample", T.LongType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("top_p", T.DoubleType()),
    T.StructField("max_new_tokens", T.IntegerType()),
    T.StructField("passes", T.IntegerType()),
    T.StructField("problems_total", T.LongType()),
    T.StructField("problems_evaluable", T.LongType()),
    T.StructField("solved_on_example", T.LongType()),
    T.StructField("example_pass_rate", T.DoubleType()),
    T.StructField("avg_new_tokens", T.DoubleType()),
    T.StructField("elapsed_sec", T.DoubleType()),
])

TRAIN_LOG = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("log_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("step", T.LongType()),
])


def struct(ddl: str) -> T.StructType:
    """A schema from its text."""
    return T.StructType.fromDDL(ddl)
