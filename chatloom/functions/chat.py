"""Rules on one chat: ``messages`` is an array of (role, content) structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The public ChatML layout.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>\n"
REPLY_OPEN = "<|im_start|>assistant\n"

PROMPT_ROLES = ("system", "user")


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def prompt_turns(messages: Column) -> Column:
    """System and user turns in order; every assistant turn is left out."""
    return F.filter(messages, lambda m: m["role"].isin(*PROMPT_ROLES))


def ensure_system(messages: Column, default_text: str) -> Column:
    """Put a default system turn first unless the chat already opens with one."""
    opening = F.try_element_at(messages, F.lit(1))["role"]
    default = F.array(message("system", F.lit(default_text)))
    return F.when(opening.eqNullSafe("system"), messages).otherwise(
        F.concat(default, messages)
    )


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant turn; null without one."""
    replies = F.filter(messages, lambda m: m["role"] == "assistant")
    return F.try_element_at(replies, F.lit(-1))["content"]


def append_reply(messages: Column, reply: Column) -> Column:
    return F.concat(messages, F.array(message("assistant", reply)))


def turn_text(role: Column, content: Column) -> Column:
    """One serialised turn; a null content counts as empty. Chats are the plain
    concatenation of their turns."""
    return F.concat(F.lit(TURN_OPEN), role, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit(TURN_CLOSE))


def chat_text(messages: Column, add_reply_prompt: bool = False) -> Column:
    body = F.array_join(F.transform(messages, lambda m: turn_text(m["role"], m["content"])), "")
    return F.concat(body, F.lit(REPLY_OPEN)) if add_reply_prompt else body


def two_turn_prompt(system: Column, user: Column) -> Column:
    """Serialised system + user chat that asks for a reply."""
    return F.concat(
        turn_text(F.lit("system"), system), turn_text(F.lit("user"), user), F.lit(REPLY_OPEN)
    )


def as_struct_of_arrays(messages: Column) -> Column:
    return F.struct(
        messages["role"].alias("role"), messages["content"].alias("content")
    )


def as_array_of_structs(columns: Column) -> Column:
    zipped = F.arrays_zip(columns["role"].alias("role"), columns["content"].alias("content"))
    return F.transform(zipped, lambda m: message(m["role"], m["content"]))
