"""Token counts. The counter is a Column -> Column function, so it is pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, functions as F

from chatloom.functions.chat import turn_text
from chatloom.functions.text import WS

TokenCounter = Callable[[Column], Column]


def count_tokens(text: Column) -> Column:
    """Default rule: one token per ASCII word run and per other visible character.

    Word runs shrink to one character and white space goes away, so the count is
    a length; collecting the matches into an array is more than twice as slow.
    """
    marks = F.regexp_replace(text, r"\w+", "w")
    return F.length(F.regexp_replace(marks, f"{WS}+", "")).cast("bigint")


def turn_tokens(role: Column, content: Column, counter: TokenCounter = count_tokens) -> Column:
    """Tokens of one serialised turn.

    The layout marks end every turn with a symbol and a newline, so no token
    spans two turns and a chat's count is the sum over its turns.
    """
    return counter(turn_text(role, content))


def counter_from(encode_lengths: Callable[[list[str]], Iterable[int]]) -> TokenCounter:
    """Plug in a real tokenizer: a batch of texts in, their token counts out."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        lengths = pd.Series(list(encode_lengths(known.tolist())), index=known.index, dtype="Int64")
        return lengths.reindex(texts.index)

    return count
