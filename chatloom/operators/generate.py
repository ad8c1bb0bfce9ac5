"""Batched text generation: prompts in, texts out, with a pluggable function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from chatloom.functions.chat import two_turn_prompt
from chatloom.functions.problems import summary_request
from chatloom.functions.text import is_blank, sanitize_explanation
from chatloom.sources.prompts import SUMMARY_SYSTEM

BatchFunction = Callable[[list[str]], list[str]]


def generate(
    df: DataFrame, prompt: str, out: str, fn: BatchFunction, batch_size: int = 16,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = fn(prompt) batch by batch; null prompts give ''.

    ``fn`` sees at most ``batch_size`` texts at a time and returns as many, in
    order. Only the prompt column goes through Python. Put filters before it: no
    predicate is pushed below a Python stage.
    ``partitions`` spreads what the filters left over evenly, which pays off
    when ``fn`` costs more than moving its prompts.
    """
    if partitions:
        df = df.repartition(partitions)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            texts = pd.Series("", index=prompts.index, dtype=object)
            asked = prompts.index[prompts.notna()]
            for start in range(0, len(asked), batch_size):
                rows = asked[start:start + batch_size]
                answers = fn(prompts.loc[rows].tolist())
                if len(answers) != len(rows):
                    raise ValueError(f"{len(rows)} prompts gave {len(answers)} texts")
                texts.loc[rows] = answers
            yield texts

    return df.withColumn(out, run(prompt))


def token_batches(lengths: list[int], budget: int, most: int) -> list[list[int]]:
    """Places of texts in batches of like lengths, from the shortest on.

    A batch costs its longest text times its texts, which stays within the budget;
    a single text may be above it.
    """
    batches: list[list[int]] = []
    for place in sorted(range(len(lengths)), key=lengths.__getitem__):
        # The new text is the longest so far.
        if batches and len(batches[-1]) < most and lengths[place] * (len(batches[-1]) + 1) <= budget:
            batches[-1].append(place)
        else:
            batches.append([place])
    return batches


def generate_by_length(
    df: DataFrame, prompt: str, out: str, fn: BatchFunction, token_budget: int, batch_size: int = 64,
    tokens: Callable[[str], int] = len, padding: str | None = None, partitions: int | None = None,
) -> DataFrame:
    """``generate`` with batches of prompts of like lengths under a budget of padded tokens.

    Texts and their order are those of ``generate``; only which prompts meet in a
    batch differs. Prompts are ordered within an Arrow batch, so none moves. With
    ``padding`` a column of that name has the tokens by which a row is padded, null
    where nothing is asked; its sum over that of the prompts' is the share that
    goes to padding.
    """
    if partitions:
        df = df.repartition(partitions)

    @F.pandas_udf("text string, padded bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            texts = [""] * len(prompts)
            padded: list[int | None] = [None] * len(prompts)
            asked = [k for k, known in enumerate(prompts.notna()) if known]
            said = [prompts.iloc[k] for k in asked]
            lengths = [tokens(text) for text in said]
            for batch in token_batches(lengths, token_budget, batch_size):
                answers = fn([said[place] for place in batch])
                if len(answers) != len(batch):
                    raise ValueError(f"{len(batch)} prompts gave {len(answers)} texts")
                for place, answer in zip(batch, answers):
                    texts[asked[place]] = answer
                    padded[asked[place]] = lengths[batch[-1]] - lengths[place]
            yield pd.DataFrame({"text": texts, "padded": pd.array(padded, dtype="Int64")})

    made = df.withColumn("_made", run(prompt)).withColumn(out, F.col("_made.text"))
    made = made if padding is None else made.withColumn(padding, F.col("_made.padded"))
    return made.drop("_made")


def summarize_thinks(
    df: DataFrame, think: str, out: str, fn: BatchFunction, batch_size: int = 16,
    partitions: int | None = None, token_budget: int | None = None,
) -> DataFrame:
    """Short explanations of reasoning texts; a blank reasoning text gives ''.

    With ``token_budget`` batches hold requests of like lengths.
    """
    request = two_turn_prompt(F.lit(SUMMARY_SYSTEM), summary_request(F.col(think)))
    asked = df.withColumn("_prompt", F.when(~is_blank(F.col(think)), request))
    if token_budget is None:
        answered = generate(asked, "_prompt", "_raw", fn, batch_size, partitions)
    else:
        answered = generate_by_length(asked, "_prompt", "_raw", fn, token_budget, batch_size, partitions=partitions)
    return answered.withColumn(out, sanitize_explanation(F.col("_raw"))).drop("_prompt", "_raw")
