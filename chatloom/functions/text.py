"""Text rules on assistant replies and explanations, as Column expressions.

Everything here stays inside the JVM; whole texts are processed, and each rule
that asks for the *last* match takes all non-overlapping matches left to right
and keeps the last, because a greedy prefix pairs the marks differently.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points that count as white space in the rules, and
# the marks, patterns and limits of the rules themselves.
WS_CHARS = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same 29 as Java knows them: one table lookup instead of a dozen ranges,
# which halves the time of the patterns below.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
THINK_PATTERN = r"(?is)<think>(.*?)</think>"
FENCE_PATTERN = rf"(?s)```([a-zA-Z0-9_+\-]*){WS}*\n(.*?)```"
LENIENT_FENCE_PATTERN = r"(?s)```(?:python)?\n(.*?)```"
FENCE_MARK = "```"
PYTHON_TAGS = ("python", "py")
CPP_TAGS = ("cpp", "c++", "cc")
EXPLANATION_CHARS = 320


def wide_strip(text: Column) -> Column:
    """Drop white space of all 29 kinds at both ends (plain trim: blanks only)."""
    return F.btrim(text, F.lit(WS_CHARS))


def wide_rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | ~text.rlike(r"[^\p{IsWhite_Space}\x1c-\x1f]")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _last_match(text: Column, pattern: str, group: int) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.try_element_at(hits, F.lit(-1))


def last_think(text: Column) -> Column:
    """Content of the last think block, any case; null without one."""
    return _last_match(text, THINK_PATTERN, 1)


def last_fence(text: Column) -> Column:
    """The last fenced block as written; null without one.

    Tag and body are cut from this short text, so the whole reply is matched
    only once.
    """
    return _last_match(text, FENCE_PATTERN, 0)


def fence_tag(fence: Column) -> Column:
    return F.lower(F.regexp_extract(fence, FENCE_PATTERN, 1))


def fence_body(fence: Column) -> Column:
    return F.regexp_extract(fence, FENCE_PATTERN, 2)


def code_language(tag: Column) -> Column:
    """Normalised language; an untagged block counts as Python."""
    return (
        F.when(tag.isin(*PYTHON_TAGS) | (tag == ""), F.lit("python"))
        .when(tag.isin(*CPP_TAGS), F.lit("cpp"))
        .otherwise(tag)
    )


def lenient_code(text: Column) -> Column:
    """Last untagged or python-tagged block, else the whole text."""
    return F.coalesce(_last_match(text, LENIENT_FENCE_PATTERN, 1), text)


def sanitize_explanation(text: Column, max_chars: int = EXPLANATION_CHARS) -> Column:
    """One-line explanation without think blocks and fences, cut at a word."""
    plain = F.regexp_replace(text, r"(?is)<think>.*?</think>", " ")
    plain = F.replace(plain, F.lit(FENCE_MARK), F.lit(" "))
    plain = F.trim(F.regexp_replace(plain, f"{WS}+", " "))
    cut = F.regexp_replace(F.left(plain, F.lit(max_chars)), r" [^ ]*$", "")
    return F.when(F.length(plain) > max_chars, F.concat(cut, F.lit("..."))).otherwise(plain)


def compose_reply(explanation: Column, language: Column, code: Column) -> Column:
    """Short explanation (when there is one), blank line, fenced code."""
    fence = F.concat(
        F.lit(FENCE_MARK), language, F.lit("\n"), wide_rstrip(code), F.lit("\n" + FENCE_MARK)
    )
    return F.concat_ws("\n\n", none_if_empty(wide_strip(explanation)), fence)


def strip_prompt(decoded: Column, prompt: Column) -> Column:
    """What a model added: the decoded text after the prompt's length."""
    return F.substring(decoded, F.length(prompt) + 1, F.length(decoded))


def outputs_match(stdout: Column, expected: Column) -> Column:
    """Grade one run: equal after stripping; a missing expected text is ''.

    The exit code does not count, so a time-out passes where nothing is expected.
    """
    return wide_strip(F.coalesce(stdout, F.lit(""))) == wide_strip(
        F.coalesce(expected, F.lit(""))
    )
