from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from chatloom import schemas
from chatloom.operators import chats
from chatloom.operators.generate import generate, summarize_thinks
from chatloom.plans import prepare
from chatloom.sources.prompts import CHAT_DEFAULT_SYSTEM

CODE = "```py\nx\n```"
CHATS = {
    1: [("system", "S"), ("user", "U"), ("assistant", "old"), ("user", "V"), ("assistant", f"<think>why</think>{CODE}")],
    2: [("user", "U"), ("assistant", f"```c++\ny\n```")],
    3: [("user", "U")],
    4: [("user", "U"), ("assistant", CODE), ("assistant", "")],
    5: [("user", "U"), ("assistant", "no code")],
    6: [("assistant", CODE)],
    7: [("user", "long " * 400), ("assistant", CODE)],
    8: [("tool", "T"), ("user", "U"), ("system", "late"), ("assistant", CODE)],
    9: [],
}
OUTCOMES = {1: "kept", 2: "other_language", 3: "no_reply", 4: "no_reply", 5: "no_code", 6: "kept",
            7: "too_long", 8: "kept", 9: "no_messages"}


@pytest.fixture
def rows(spark):
    data = [(k, [{"role": r, "content": c} for r, c in v], None, None, None) for k, v in CHATS.items()]
    return spark.createDataFrame([*data, (10, None, None, None, None)], schemas.CHAT_ROWS)


@pytest.fixture
def turns(spark):
    data = [(k, i, r, c) for k, v in CHATS.items() for i, (r, c) in enumerate(v)]
    return spark.createDataFrame(data, schemas.CHAT_TURNS).repartition(5)


def as_lists(prepared):
    return {
        r["source_idx"]: ([(m["role"], m["content"]) for m in r["messages"]], r["language"])
        for r in prepared.collect()
    }


def expected():
    def chat(*head, reply):
        return [*head, ("assistant", reply)]

    default = ("system", CHAT_DEFAULT_SYSTEM)
    fence = "```python\nx\n```"
    return {
        1: (chat(("system", "S"), ("user", "U"), ("user", "V"), reply=f"why\n\n{fence}"), "python"),
        6: (chat(default, reply=fence), "python"),
        8: (chat(default, ("user", "U"), ("system", "late"), reply=fence), "python"),
    }


def test_rows_and_turns_give_the_expected_chats(rows, turns):
    assert as_lists(prepare.prepare_chats(rows, "python", 256)) == expected()
    assert as_lists(prepare.prepare_turns(turns, "python", 256)) == expected()


def test_finished_chats_are_left_out(rows, turns, spark):
    done = spark.createDataFrame([(1,), (1,), (None,), (99,)], "source_idx LONG")
    for made in (prepare.prepare_chats(rows, "python", 256, done=done), prepare.prepare_turns(turns, "python", 256, done=done)):
        assert as_lists(made) == {k: v for k, v in expected().items() if k != 1}


def test_any_language_keeps_the_others(turns):
    kept = as_lists(prepare.prepare_turns(turns, "any", 256))
    assert kept[2][1] == "cpp" and set(kept) == {1, 2, 6, 8}


def test_output_schema(rows):
    assert [f.name for f in prepare.prepare_chats(rows).schema] == schemas.PREPARED_CHATS.fieldNames()


def test_funnel_adds_up(rows, turns):
    counted = dict(prepare.funnel(prepare.profile_chats(rows), "python", 256).collect())
    want = {}
    for outcome in [*OUTCOMES.values(), "no_messages"]:
        want[outcome] = want.get(outcome, 0) + 1
    assert counted == want
    flat = dict(prepare.funnel(prepare.profile_turns(turns), "python", 256).collect())
    assert {**want, "no_messages": 0} == {"no_messages": 0, **flat}


def test_token_guard_keeps_the_limit_itself(turns):
    drafted = prepare.draft(prepare.screen(prepare.profile_turns(turns)), 10_000)
    exact = drafted.filter("source_idx = 7").first()["num_tokens_serialized"]
    assert 7 in as_lists(prepare.prepare_turns(turns, "python", exact))
    assert 7 not in as_lists(prepare.prepare_turns(turns, "python", exact - 1))


def test_tokens_are_those_of_the_serialised_chat(turns):
    from chatloom.functions.chat import chat_text
    from chatloom.functions.tokens import count_tokens

    made = prepare.prepare_turns(turns, "any", 10_000)
    counted = made.withColumn("again", count_tokens(chat_text(F.col("messages"))))
    assert counted.filter("again <> num_tokens_serialized").count() == 0


def test_a_hot_chat_leaves_before_the_shuffle(spark):
    """A third of all turns in one chat: it meets in no task, and no other chat is lost."""
    ids = spark.range(0, 60_000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise((F.col("id") / 6).cast("bigint") + 1).alias("source_idx"),
        F.col("id").alias("turn"),
    )
    is_reply = F.col("turn") % 3 == 2
    turns = ids.select(
        "source_idx", "turn", F.when(is_reply, "assistant").otherwise("user").alias("role"),
        F.when(is_reply, CODE).otherwise("ask").alias("content"),
    ).union(spark.createDataFrame([(0, 10**9, "assistant", CODE)], schemas.CHAT_TURNS))
    made = prepare.prepare_turns(turns, max_seq_len=256)
    kept = turns.filter("role = 'assistant' AND source_idx <> 0").select("source_idx").distinct()
    assert made.select("source_idx").exceptAll(kept).count() == 0
    assert kept.exceptAll(made.select("source_idx")).count() == 0


def test_null_contents_are_empty_texts(spark):
    """A chat of a hundred turns without content costs their marks in both forms."""
    data = [(1, k, "user", None) for k in range(100)] + [(1, 100, "assistant", CODE)]
    flat = spark.createDataFrame(data, schemas.CHAT_TURNS)
    whole = chats.assemble_chats(flat).drop("part", "parts")
    for limit in (60, 5000):
        one, two = (as_lists(m) for m in (prepare.prepare_turns(flat, "python", limit), prepare.prepare_chats(whole, "python", limit)))
        assert one == two and len(one) == (limit == 5000)


@pytest.mark.parametrize("part_bytes", [1, 90, 250, 10**6])
def test_parts_never_change_the_chats(spark, turns, part_bytes):
    parts = chats.assemble_chats(turns, part_bytes)
    assert as_lists(prepare.prepare_chats(parts, "python", 256)) == expected()


def test_no_row_is_above_the_budget(spark):
    """Skewed turns in a chat with most of all rows; a turn above the budget stands alone."""
    turns = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, 1 + F.col("id") % 7).otherwise(0).alias("source_idx"), "id",
        F.lit("user").alias("role"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(97)).cast("int") * F.when(F.col("id") % 501 == 0, 40).otherwise(1)).alias("content"),
    ).withColumn("turn", F.row_number().over(Window.partitionBy("source_idx").orderBy("id")) - 1).drop("id")
    packed = chats.assemble_chats(turns.select(*schemas.CHAT_TURNS.fieldNames()), part_bytes=1000)
    sizes = packed.select("source_idx", "part", "parts", F.size("messages").alias("n"), F.aggregate(
        "messages", F.lit(0), lambda all_, m: all_ + F.octet_length(m["content"]) + F.octet_length(m["role"]) + chats.TURN_BYTES
    ).alias("bytes")).collect()
    assert all(r["bytes"] <= 1000 or r["n"] == 1 for r in sizes) and max(r["bytes"] for r in sizes) > 1000
    assert sum(r["bytes"] for r in sizes) / len(sizes) > 300
    for key in {r["source_idx"] for r in sizes}:
        own = sorted((r for r in sizes if r["source_idx"] == key), key=lambda r: r["part"])
        assert {r["parts"] for r in own} == {len(own)}
        assert all(a["part"] + a["n"] == b["part"] for a, b in zip(own, own[1:])) and own[0]["part"] == 0
    back = chats.explode_turns(packed)
    assert back.exceptAll(turns.select(*back.columns)).isEmpty() and back.count() == 3000


def test_only_kept_chats_turns_are_sorted_or_shuffled_with_their_content(spark, turns):
    plan = prepare.prepare_turns(turns, "python", 256)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert plan.count("LeftSemi") >= 1


def test_round_trip_of_long_chats(spark):
    turns = spark.range(1000).select(
        (F.col("id") % 3).alias("source_idx"), (F.col("id") / 3).cast("bigint").alias("turn"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("content"),
    )
    packed = chats.assemble_chats(turns, part_bytes=4000)
    assert packed.filter(F.size("messages") > 100).count() == 0 and packed.count() >= 12
    back = chats.explode_turns(packed)
    assert sorted(back.collect()) == sorted(turns.collect())


def test_generation_keeps_order_and_skips_blanks(spark):
    seen = spark.sparkContext.accumulator(0)
    texts = [(i, None if i % 5 == 0 else f"<think>t{i}</think>") for i in range(50)]
    df = spark.createDataFrame(texts, "i INT, p STRING").coalesce(1)

    def shout(batch):
        assert 0 < len(batch) <= 4
        seen.add(len(batch))
        return [t.upper() for t in batch]

    got = generate(df, "p", "o", shout, batch_size=4).collect()
    assert seen.value == 40
    assert [tuple(r) for r in got] == [(i, t, t.upper() if t else "") for i, t in texts]


def test_summaries_are_sanitised(spark):
    df = spark.createDataFrame([(1, "because"), (2, " "), (3, None)], "i INT, think STRING")
    got = summarize_thinks(df, "think", "s", lambda batch: [f"<think>x</think> a  b ``` {len(batch)}" for _ in batch])
    assert [r["s"] for r in got.orderBy("i").collect()] == ["a b 1", "", ""]


def test_a_summary_table_can_replace_the_model(turns, spark):
    from chatloom.operators.resume import attach_summaries

    stored = spark.createDataFrame([(1, "stored")], "source_idx LONG, summary STRING")
    made = as_lists(prepare.prepare_turns(
        turns, "python", 256, summarize=lambda df: attach_summaries(df, stored)
    ))
    assert made[1][0][-1] == ("assistant", "stored\n\n```python\nx\n```")
    assert made[6][0][-1] == ("assistant", "```python\nx\n```")


def test_random_chats_rows_equal_turns(spark):
    rng = random.Random(4)
    data = []
    for chat in range(300):
        messages = [
            (rng.choice(["system", "user", "assistant", "assistant"]),
             "".join(rng.choice(["```\n", "```\n", "```py\n", "a b ", "<think>", "</think>", "c++"]) for _ in range(rng.randint(0, 12))))
            for _ in range(rng.randint(1, 6))
        ]
        data.append((chat, [{"role": r, "content": c} for r, c in messages], None, None, None))
    rows = spark.createDataFrame(data, schemas.CHAT_ROWS)
    narrow = prepare.prepare_chats(rows, max_seq_len=200)
    wide = prepare.prepare_turns(chats.explode_turns(rows), max_seq_len=200)
    got = sorted(narrow.collect(), key=lambda r: r["source_idx"])
    assert got == sorted(wide.collect(), key=lambda r: r["source_idx"])
    assert 20 < len(got) < 300
    for row in got:
        assert row["messages"][0]["role"] == "system"
        assert row["messages"][-1]["role"] == "assistant"
        assert row["num_tokens_serialized"] <= 200
