"""Chats as rows (``messages`` arrays) and as turns (one row per message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chatloom.functions import chat
from chatloom.functions.tokens import TokenCounter, count_tokens, turn_tokens
from chatloom.operators.scan import running_sums

PART_BYTES = 64 << 20
# What a turn takes beside its texts.
TURN_BYTES = 32


def explode_turns(chats: DataFrame) -> DataFrame:
    """(source_idx, messages[, part]) rows to (source_idx, turn, role, content).

    A part's number is that of its first turn, so nothing has to be known of how
    chats were cut.
    """
    first = F.coalesce("part", F.lit(0)) if "part" in chats.columns else F.lit(0)
    turns = chats.select(
        "source_idx", first.alias("_first"), F.posexplode("messages").alias("_pos", "_m")
    )
    return turns.select(
        "source_idx",
        (F.col("_first") + F.col("_pos")).cast("bigint").alias("turn"),
        F.col("_m.role").alias("role"),
        F.col("_m.content").alias("content"),
    )


def turn_bytes() -> Column:
    size = lambda name: F.coalesce(F.octet_length(name), F.lit(0)).cast("bigint")
    return size("role") + size("content") + TURN_BYTES


def _rows(turns: DataFrame, *keys: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    return turns.groupBy("source_idx", *keys).agg(
        F.min("turn").cast("bigint").alias("part"),
        F.transform(ordered, lambda m: chat.message(m["role"], m["content"])).alias("messages"),
    )


def assemble_chats(turns: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Turns back to chat rows in turn order: source_idx, part, messages, parts.

    A chat of more than ``part_bytes`` comes back as several rows, of ``parts`` in
    all, each numbered by its first turn; all others are one row with part 0. No row
    is above the budget but a single turn that is. Where a part begins follows from
    the bytes before a turn, a running sum over slices, so a hot chat is cut by as
    many tasks as it fills. Turns count from 0 without gaps.
    """
    turns = turns.filter("source_idx IS NOT NULL").select("source_idx", "turn", "role", "content")
    sizes = turns.select("source_idx", turn_bytes().alias("_bytes")).groupBy("source_idx").agg(F.sum("_bytes").alias("_bytes"))
    long = sizes.filter(F.col("_bytes") > part_bytes).select("source_idx")
    if long.isEmpty():
        return _rows(turns).withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    short = _rows(turns.join(long, "source_idx", "left_anti"))
    short = short.withColumns({"part": F.lit(0).cast("bigint"), "parts": F.lit(1).cast("bigint")})
    # Turns that begin in one half of a budget fill one budget at most; larger turns stand alone.
    half = max(1, part_bytes // 2)
    large = (turn_bytes() > half).cast("bigint")
    placed = running_sums(
        turns.join(long, "source_idx", "left_semi"), {"_before": turn_bytes(), "_large": large}, ["turn"], ["source_idx"]
    )
    cuts = {"_half": F.floor(F.col("_before") / half), "_run": F.col("_large") * 2 + large}
    cut = placed.withColumns(cuts)
    parts = cut.select("source_idx", *cuts).distinct().groupBy("source_idx").agg(F.count(F.lit(1)).alias("parts"))
    rows = _rows(cut, *cuts).drop(*cuts).join(parts, "source_idx")
    return short.unionByName(rows)


def last_of_role(turns: DataFrame, role: str = "assistant") -> DataFrame:
    """Last turn of a role per chat: a partial maximum of its number, then an equi join
    on the unique (source_idx, turn), so hot chats never meet in one task."""
    said = turns.filter(F.col("role") == role)
    latest = said.groupBy("source_idx").agg(F.max("turn").alias("turn"))
    return latest.join(said.select("source_idx", "turn", "content"), ["source_idx", "turn"])


def role_token_profile(turns: DataFrame, counter: TokenCounter = count_tokens) -> DataFrame:
    """Turns, tokens and assistant-only tokens per chat (what the masked loss trains on)."""
    spent = turns.select(
        "source_idx", "role", turn_tokens(F.col("role"), F.col("content"), counter).alias("_tok")
    )
    reply_tokens = F.when(F.col("role") == "assistant", F.col("_tok")).otherwise(0)
    return spent.groupBy("source_idx").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("_tok").alias("tokens"),
        F.sum(reply_tokens).alias("assistant_tokens"),
    )
