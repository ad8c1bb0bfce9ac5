from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import text
from chatloom.functions.tokens import count_tokens, counter_from

CPP_THEN_PYTHON = "```cpp\nX\n```\n text ```python\nY```"


def code(t):
    fence = text.last_fence(t)
    return F.concat_ws("|", text.fence_tag(fence), text.fence_body(fence))


@pytest.mark.parametrize("rule, given, expected", [
    (text.last_think, "<think>a<think>b</think>c", "a<think>b"),
    (text.last_think, "x <THINK>\nq</Think> y <think>z</think>", "z"),
    (text.last_think, "no mark", None),
    (text.last_think, "<think></think>", ""),
    (code, CPP_THEN_PYTHON, "python|Y"),
    (text.lenient_code, CPP_THEN_PYTHON, " text "),
    (code, "```python  \n\n   print(1)\n```", "python|   print(1)\n"),
    (code, "```c#\nfoo\n```\nbar\n```py\nbaz```", "|bar\n"),
    (text.last_fence, "no fence", None),
    (text.last_fence, None, None),
    (text.lenient_code, "no fence", "no fence"),
    (text.lenient_code, "```Python\nx\n```", "```Python\nx\n```"),
    (text.sanitize_explanation, "x" * 330, "x" * 320 + "..."),
    (text.sanitize_explanation, "ab cd " * 60, "ab cd " * 52 + "ab cd..."),
    (text.sanitize_explanation, "x" * 320, "x" * 320),
    (text.sanitize_explanation, " a  b <Think>q</THINK>``` c\x1f", "a b c"),
    (text.code_language, "", "python"),
    (text.code_language, "py", "python"),
    (text.code_language, "c++", "cpp"),
    (text.code_language, "cc", "cpp"),
    (text.code_language, "rust", "rust"),
    (text.wide_strip, "　\x1c a b\x85\n", "a b"),
    (text.wide_rstrip, " a\t\n ", " a"),
    (text.is_blank, " \n", True),
    (text.is_blank, None, True),
    (text.is_blank, " x", False),
])
def test_golden_rows(eval_one, rule, given, expected):
    assert eval_one(rule, [given]) == [expected]


def test_cut_at_a_word_end_loses_the_whole_word(eval_one):
    words = "abc " * 80 + "tail"
    assert words[319] == " "
    assert eval_one(text.sanitize_explanation, [words]) == ["abc " * 79 + "abc..."]
    words = "ab " + "abc " * 80
    assert eval_one(text.sanitize_explanation, [words]) == [words[:318] + "..."]


# The rules once more in plain Python, to compare on random texts.
SPACES = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]


def py_think(t):
    found = re.compile("<think>((?s:.)*?)</think>", re.IGNORECASE | re.ASCII).findall(t)
    return found[-1] if found else None


def py_code(t):
    last = None
    for hit in re.finditer(r"```([\w+\-]*)(?=[^\n]*\n)\s*\n((?s:.)*?)```", t):
        if re.fullmatch(r"[a-zA-Z0-9_+\-]*", hit[1]):
            last = f"{hit[1].lower()}|{hit[2]}"
    return last


def py_lenient(t):
    blocks = [m[1] for m in re.finditer("```(?:python)?\n((?s:.)*?)```", t)]
    return blocks.pop() if blocks else t


def py_sanitize(t):
    t = re.compile("<think>(?s:.)*?</think>", re.IGNORECASE | re.ASCII).sub(" ", t)
    line = " ".join(t.replace("```", " ").split())
    if len(line) <= 320:
        return line
    head, blank, _ = line[:320].rpartition(" ")
    return (head if blank else line[:320]) + "..."


def random_texts(n, seed):
    rng = random.Random(seed)
    pieces = ["```", "python", "py", "c++", "<think>", "</think>", "<THINK>", "</Think>", "\n", " ",
              "a", "Bc", "é", "x1", " ", " ", "\x1c", "\x0b", "print(1)", "``", "`", "word " * 20]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("rule, statement", [
    (text.last_think, py_think),
    (text.lenient_code, py_lenient),
    (text.sanitize_explanation, py_sanitize),
    (text.wide_strip, str.strip),
    (text.wide_rstrip, str.rstrip),
])
def test_rules_agree_with_python_on_random_texts(eval_one, rule, statement):
    texts = random_texts(3000, seed=rule.__name__)
    assert eval_one(rule, texts) == [statement(t) for t in texts]


def test_code_blocks_agree_with_python_on_random_texts(eval_one):
    texts = random_texts(3000, seed=5)

    def rule(t):
        return F.when(text.last_fence(t).isNotNull(), code(t))

    assert eval_one(rule, texts) == [py_code(t) for t in texts]


def test_white_space_class_is_pythons(eval_one):
    every = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    stripped = eval_one(text.wide_strip, every)
    assert [c for c, s in zip(every, stripped) if s == ""] == SPACES


def test_token_count_equals_counting_matches(eval_one):
    texts = random_texts(2000, seed=3)
    pattern = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
    assert eval_one(count_tokens, texts) == [len(pattern.findall(t)) for t in texts]


def test_plugged_in_counter(eval_one):
    counter = counter_from(lambda batch: [len(t) for t in batch])
    assert eval_one(counter, ["abc", None, ""]) == [3, None, 0]


def test_compose_reply_drops_a_blank_explanation(spark):
    row = spark.createDataFrame(
        [(" why ", "python", "x = 1 \n\n"), (" ", "cpp", " y")], "e STRING, l STRING, c STRING"
    )
    made = row.select(text.compose_reply(row["e"], row["l"], row["c"]).alias("r")).collect()
    assert [r["r"] for r in made] == ["why\n\n```python\nx = 1\n```", "```cpp\n y\n```"]


def test_outputs_match(spark):
    rows = [(" 1\n", "1"), ("", " "), (None, ""), ("1", "2"), ("1", None)]
    table = spark.createDataFrame(rows, "o STRING, e STRING")
    assert [r[0] for r in table.select(text.outputs_match(table["o"], table["e"])).collect()] == [
        True, True, True, False, False
    ]
