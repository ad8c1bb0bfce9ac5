"""Long reasoning chats to short training chats.

Stage order: profile (one row per chat, no message list) -> screen (cheap
checks, last code block, language) -> draft (summary, reply, token guard) ->
attach the system and user turns. Finished chats leave before anything else. Only
the system and user turns of chats that passed the token guard are shuffled and
collected; as every turn costs at least its marks, a collected chat has at most
``max_seq_len`` turns however long the hottest chat is.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from chatloom.functions import chat, text
from chatloom.functions.tokens import TokenCounter, count_tokens, turn_tokens
from chatloom.operators.chats import explode_turns
from chatloom.operators.columns import compute_once
from chatloom.operators.filters import language_is
from chatloom.operators.resume import not_done
from chatloom.schemas import MESSAGE
from chatloom.sources.prompts import CHAT_DEFAULT_SYSTEM

Summarize = Callable[[DataFrame], DataFrame]

MAX_SEQ_LEN = 8192


# The outcomes of a chat, those of the screen and those of the draft.
SCREENED = ("no_messages", "no_reply", "no_code", "other_language")
DRAFTED = ("too_long", "kept")


class Funnel:
    """Chats per outcome, counted by the run that writes them.

    Hand it to ``prepare_chats`` or ``prepare_turns`` and ask after the rows have been
    written: the counts are metrics observed in front of the filters, so nothing is
    computed twice. A task that runs again after a loss may be counted again;
    ``funnel`` counts anew where that matters.
    """

    PATIENCE = 30.0

    def __init__(self):
        self._observed: list[tuple[Observation, tuple[str, ...], DataFrame]] = []

    def watch(self, rows: DataFrame, outcomes: tuple[str, ...]) -> DataFrame:
        """Rows as they are, with their ``reason`` (null: kept) observed."""
        observation = Observation()
        counts = [F.count_if(F.coalesce("reason", F.lit("kept")) == name).alias(name) for name in outcomes]
        self._observed.append((observation, outcomes, rows))
        return rows.observe(observation, *counts)

    def chats(self) -> dict[str, int]:
        """Chats per outcome that occurred, once the run has ended."""
        total: Counter[str] = Counter()
        for observation, outcomes, rows in self._observed:
            total.update(self._arrived(observation) or self._counted(rows, outcomes))
        return {name: n for name, n in total.items() if n}

    def _arrived(self, observation: Observation) -> dict[str, int] | None:
        """Metrics come shortly after the run's end, unless its plan lost them: where
        nothing passes, later stages are cut off at run time."""
        until = time.monotonic() + self.PATIENCE
        future = observation._jo.future()
        while not future.isCompleted() and time.monotonic() < until:
            time.sleep(0.02)
        return observation.get if future.isCompleted() else None

    @staticmethod
    def _counted(rows: DataFrame, outcomes: tuple[str, ...]) -> dict[str, int]:
        found = rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).count().collect()
        return {r["outcome"]: r["count"] for r in found if r["outcome"] in outcomes}


def _watched(rows: DataFrame, seen: Funnel | None, outcomes: tuple[str, ...]) -> DataFrame:
    return rows if seen is None else seen.watch(rows, outcomes)


def think_as_summary(df: DataFrame) -> DataFrame:
    """Stand-in summary without a model: the sanitised reasoning text itself."""
    return df.withColumn("summary", text.sanitize_explanation(F.coalesce("think", F.lit(""))))


def profile_turns(turns: DataFrame, counter: TokenCounter = count_tokens) -> DataFrame:
    """One row per chat from flat turns.

    Numbers are partial aggregates; the one reply a chat needs is then found by an
    equi join on its unique (source_idx, turn).
    """
    is_prompt = F.col("role").isin(*chat.PROMPT_ROLES)
    at = lambda role: F.when(F.col("role") == role, F.col("turn"))
    numbers = turns.select(
        "source_idx",
        F.when(is_prompt, turn_tokens(F.col("role"), F.col("content"), counter)).alias("_tok"),
        *[at(role).alias(f"_{role}") for role in (*chat.PROMPT_ROLES, "assistant")],
    ).groupBy("source_idx").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.coalesce(F.sum("_tok"), F.lit(0)).alias("prompt_tokens"),
        *[F.min(f"_{role}").alias(f"_{role}") for role in chat.PROMPT_ROLES],
        F.max("_assistant").alias("turn"),
    )
    opening = F.when(
        F.col("_system").isNotNull() & (F.col("_user").isNull() | (F.col("_system") < F.col("_user"))), "system"
    ).when(F.col("_user").isNotNull(), "user")
    replies = turns.filter("role = 'assistant'").select("source_idx", "turn", F.col("content").alias("reply"))
    return numbers.join(replies, ["source_idx", "turn"], "left").select(
        "source_idx", "n_turns", "prompt_tokens", opening.alias("opening_role"), "reply"
    )


def profile_chats(chats: DataFrame, counter: TokenCounter = count_tokens) -> DataFrame:
    """The same row from chat rows, without a shuffle."""
    prompt = chat.prompt_turns(F.col("messages"))
    return chats.select(
        "source_idx",
        F.coalesce(F.size("messages"), F.lit(0)).cast("bigint").alias("n_turns"),
        F.coalesce(counter(chat.chat_text(prompt)), F.lit(0)).alias("prompt_tokens"),
        F.try_element_at(prompt, F.lit(1))["role"].alias("opening_role"),
        chat.last_assistant(F.col("messages")).alias("reply"),
        prompt.alias("prompt"),
    )


def screen(profile: DataFrame, language: str = "any") -> DataFrame:
    """Add code, language, think and the first reason to leave a chat out (or null)."""
    found = compute_once(profile, _fence=text.last_fence(F.col("reply")))
    named = found.withColumn("language", text.code_language(text.fence_tag(F.col("_fence"))))
    reason = (
        F.when(F.col("n_turns") <= 0, "no_messages")
        .when(F.coalesce("reply", F.lit("")) == "", "no_reply")
        .when(F.col("_fence").isNull(), "no_code")
        .when(~language_is(F.col("language"), language), "other_language")
    )
    return (
        named.withColumn("reason", reason)
        .withColumn("code", text.fence_body(F.col("_fence")))
        .withColumn("think", F.when(F.col("reason").isNull(), text.last_think(F.col("reply"))))
        .drop("_fence")
    )


def draft(
    screened: DataFrame,
    max_seq_len: int = MAX_SEQ_LEN,
    summarize: Summarize = think_as_summary,
    default_system: str = CHAT_DEFAULT_SYSTEM,
    counter: TokenCounter = count_tokens,
) -> DataFrame:
    """Short reply, its chat's token count, and ``reason`` extended by the token guard."""
    replied = summarize(screened)
    replied = compute_once(
        replied,
        answer=text.compose_reply(F.col("summary"), F.col("language"), F.col("code")),
    )
    added_system = F.when(
        F.col("opening_role").eqNullSafe("system"), F.lit(0)
    ).otherwise(turn_tokens(F.lit("system"), F.lit(default_system), counter))
    total = F.col("prompt_tokens") + added_system + turn_tokens(
        F.lit("assistant"), F.col("answer"), counter
    )
    counted = compute_once(replied, num_tokens_serialized=total.cast("bigint"))
    too_long = F.when(F.col("num_tokens_serialized") > max_seq_len, "too_long")
    return counted.withColumn("reason", F.coalesce("reason", too_long))


def collect_prompts(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Kept chats with their system and user turns in order.

    The turns of all other chats leave at the semi join, which AQE splits where a
    chat is hot. ``kept`` has one row per chat and joins the collected turns 1:1.
    """
    asked = turns.filter(F.col("role").isin(*chat.PROMPT_ROLES)).select(
        "source_idx", F.struct("turn", "role", "content").alias("_turn")
    ).join(kept.select("source_idx"), "source_idx", "left_semi")
    ordered = F.sort_array(F.collect_list("_turn"))
    collected = asked.groupBy("source_idx").agg(
        F.transform(ordered, lambda m: chat.message(m["role"], m["content"])).alias("prompt")
    )
    none = F.array().cast(T.ArrayType(MESSAGE))
    return kept.join(collected, "source_idx", "left").withColumn("prompt", F.coalesce("prompt", none))


def finish(kept: DataFrame, default_system: str = CHAT_DEFAULT_SYSTEM) -> DataFrame:
    """The output record."""
    prompt = chat.ensure_system(F.col("prompt"), default_system)
    return kept.select(
        chat.append_reply(prompt, F.col("answer")).alias("messages"),
        "language", "num_tokens_serialized", "source_idx",
    )


def prepare_chats(
    chats: DataFrame,
    language: str = "any",
    max_seq_len: int = MAX_SEQ_LEN,
    summarize: Summarize = think_as_summary,
    default_system: str = CHAT_DEFAULT_SYSTEM,
    counter: TokenCounter = count_tokens,
    done: DataFrame | None = None,
    seen: Funnel | None = None,
) -> DataFrame:
    """Training chats from chat rows.

    Whole chats are narrow from scan to output, but for the join that leaves out
    finished rows when there are any. Rows that are one of several ``parts`` of a
    chat are taken as turns, so it does not matter how chats are cut.
    """
    if "parts" in chats.columns:
        options = (language, max_seq_len, summarize, default_system, counter, done)
        whole = chats.filter("coalesce(parts, 1) <= 1").drop("part", "parts")
        turns = explode_turns(chats.filter("parts > 1"))
        return prepare_chats(whole, *options, seen=seen).unionByName(prepare_turns(turns, *options, seen=seen))
    if done is not None:
        chats = not_done(chats, done, "source_idx")
    screened = _watched(screen(profile_chats(chats, counter), language), seen, SCREENED)
    drafted = draft(screened.filter("reason IS NULL"), max_seq_len, summarize, default_system, counter)
    return finish(_watched(drafted, seen, DRAFTED).filter("reason IS NULL"), default_system)


def prepare_turns(
    turns: DataFrame,
    language: str = "any",
    max_seq_len: int = MAX_SEQ_LEN,
    summarize: Summarize = think_as_summary,
    default_system: str = CHAT_DEFAULT_SYSTEM,
    counter: TokenCounter = count_tokens,
    done: DataFrame | None = None,
    seen: Funnel | None = None,
) -> DataFrame:
    """Training chats from flat turns. Finished chats leave before any token is counted."""
    if done is not None:
        turns = not_done(turns, done, "source_idx")
    screened = _watched(screen(profile_turns(turns, counter), language), seen, SCREENED)
    drafted = draft(screened.filter("reason IS NULL"), max_seq_len, summarize, default_system, counter)
    kept = _watched(drafted, seen, DRAFTED).filter("reason IS NULL").select(
        "source_idx", "answer", "language", "num_tokens_serialized"
    )
    return finish(collect_prompts(turns, kept), default_system)


def funnel(
    profile: DataFrame,
    language: str = "any",
    max_seq_len: int = MAX_SEQ_LEN,
    summarize: Summarize = think_as_summary,
    default_system: str = CHAT_DEFAULT_SYSTEM,
    counter: TokenCounter = count_tokens,
) -> DataFrame:
    """Chats per outcome: kept, or the first reason they were left out."""
    drafted = draft(screen(profile, language), max_seq_len, summarize, default_system, counter)
    outcome = F.coalesce("reason", F.lit("kept"))
    return drafted.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("chats"))
