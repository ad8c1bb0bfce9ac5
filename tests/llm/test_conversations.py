from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from conftest import SF_DIR
from helpers import CLASHING
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from chatloom.llm import conversations as repair
from chatloom.llm.queries import QUERIES

ROWS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """The contract's damage, row by row."""
    spaced = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (conv, turn, "user" if fate == 4 else role, text)
        yield from [row, row] if fate == 3 else [row]


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        last = SEEN.findall(text)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else
                     "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Least (cost, edits) over all ways, and the repaired rows."""
    due = lambda state: "a" if state == "u" else "u"

    @lru_cache(None)
    def best(at, state, inserts):
        ways = []
        if at == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            cost, edits, said = best(at, due(state), inserts + 1)
            ways.append((cost + 2, "I" + edits, (("assistant" if state == "u" else "user") + ":", *said)))
        if at < len(rows):
            (role, text), fault = rows[at], found[at]
            cost, edits, said = best(at + 1, state, 0)
            ways.append((cost + 3, "D" + edits, said))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                first = role[:1]
                if (first == "s" and state == "") or (first in ("u", "a") and first == due(state)):
                    cost, edits, said = best(at + 1, first, 0)
                    ways.append((cost + more, "K" + edits, (f"{role}:{text}", *said)))
                cost, edits, said = best(at + 1, due(state), 0)
                ways.append((cost + more + 2, "R" + edits, (f"{'assistant' if state == 'u' else 'user'}:{text}", *said)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_report(rows):
    """Every conversation's row by brute force; ``rows`` after damage."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    result = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        said = [r[1:] for r in own]
        found = faults(said)
        turns = [r[0] for r in own if r[0] is not None]
        cost, edits, left = cheapest(tuple(said), tuple(found))
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])),
            cost, edits, hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return result


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reported(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_the_query_equals_brute_force_on_the_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    want = plain_report(damaged(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for conv, *_ in rows:
        want.setdefault(conv, empty)
    assert reported(QUERIES["op13_conversation_repair"](spark, SF_DIR)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=9))
def test_crossings_give_the_least_of_the_cheapest(codes):
    rows = tuple((("system", "user", "assistant", "tool")[c // 3], f"{k}.") for k, c in enumerate(codes))
    found = tuple(("", "blank", "truncated")[c % 3] for c in codes)
    cost, edits, _ = cheapest(rows, found)
    assert repair.whole([repair.PLAIN_STEPS[c] for c in codes]) == (edits, cost)


def test_a_count_of_repeats_costs_as_much_as_the_rows():
    for code in range(12):
        first = repair.PLAIN_STEPS[code]
        gone = repair.PLAIN_STEPS[3 * (code // 3) + 1]
        for around in range(12):
            other = repair.PLAIN_STEPS[around]
            assert repair.whole([other, repair.item_step(code, 2), other]) == repair.whole([other, first, gone, gone, other])


def long_rows(count, conv):
    roles = ("user", "assistant", "user", "system", "assistant", "tool")
    return [(conv, k // 2, roles[(k * k + conv) % 6], f"text {k % (count - 7)}" + ".!? "[k % 4]) for k in range(count)]


def test_long_conversations_are_solved_block_by_block(spark):
    rows = long_rows(60, 1) + long_rows(31, 2) + long_rows(4, 3) + [(9, k, "user", "same.") for k in range(40)]
    df = spark.createDataFrame(rows, ROWS)
    want = plain_report(rows)
    assert reported(repair.audit_conversations(df, block=4, fan=3)) == want
    assert reported(repair.audit_conversations(df)) == want


def test_repaired_rows_follow_the_audit(spark):
    rows = long_rows(60, 1) + long_rows(9, 2)
    df = spark.createDataFrame(rows, ROWS)
    found = repair.repair_conversations(df, block=8, fan=2).orderBy("conv_id", "place").collect()
    for conv, report in plain_report(rows).items():
        own = [r for r in found if r["conv_id"] == conv]
        assert [r["place"] for r in own] == list(range(len(own)))
        assert "".join(r["edit"] for r in own) == report[6].replace("D", "")
        said = "\n".join(f"{r['role']}:{r['text']}" for r in own)
        assert hashlib.sha256(said.encode()).hexdigest() == report[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert all((r["turn"] is None) == (r["edit"] == "I") for r in own)


ODD = [
    (1, 0, None, None), (1, None, "user", "first?"), (1, 1, "user", ""), (1, 1, "user", ""),
    (2, 0, "user", "x " * 40_000), (2, 1, "", "no role."), (2, 1, "unknown", "a u role."),
    (None, 0, "system", "s."), (None, 5, "user", "hello!\n"), (None, None, None, None),
    (3, None, "assistant", "a."), (3, None, "assistant", "a."),
    (4, 7, "user", "é🙂."), (4, 7, "assistant", "ends… "), (4, 7, "assistant", "ends… "),
]


def test_odd_rows_repeats_and_clashing_names(spark):
    df = spark.createDataFrame(ODD, ROWS).select("*", *[F.lit(f"own {name}").alias(name) for name in CLASHING])
    assert reported(repair.audit_conversations(df)) == plain_report([(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD])
    hurt = reported(repair.audit_conversations(repair.damage(df), known=df))
    assert set(hurt) == {1, 2, 3, 4, None}


def test_a_conversation_of_one_repeated_row_is_one_item(spark):
    df = spark.range(5000).select(
        F.lit(1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"),
        F.lit("user").alias("role"), F.lit("again.").alias("text"),
    )
    found = reported(repair.audit_conversations(df))[1]
    assert found[:6] == (0, 0, 4999, 0, 4999, 3 * 4999 + 2)
    assert found[6] == "K" + "D" * 4999 + "I"


def test_ids_of_another_type_and_an_empty_table(spark):
    named = spark.createDataFrame([("a", 0, "user", "x."), ("", 0, "user", "y."), (None, 0, "user", "z.")], "conv_id STRING, turn INT, role STRING, text STRING")
    assert set(reported(repair.audit_conversations(named))) == {"a", "", None}
    none = spark.createDataFrame([], ROWS)
    assert repair.audit_conversations(none, known=none).collect() == []
    assert repair.repair_conversations(none).collect() == []


def test_conversations_without_rows_are_reported(spark):
    every = spark.createDataFrame([(k, 0, "user", "x.") for k in range(100)], ROWS)
    found = reported(repair.audit_conversations(repair.damage(every), known=every))
    gone = {k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0}
    assert gone and {k for k, v in found.items() if v[6] == ""} >= gone
    assert all(found[k] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)


@pytest.mark.parametrize("entry", repair.STATES)
def test_tables_of_blocks_join(entry):
    steps = [repair.PLAIN_STEPS[(k * 5 + 1) % 12] for k in range(20)]
    tables = [repair.table_step(*repair.table_of(steps[k:k + 5])) for k in range(0, 20, 5)]
    cost, rank = repair.forward(steps, entry, 0, 20)
    assert repair.forward(tables, entry, 0, 4) == (cost, rank)
