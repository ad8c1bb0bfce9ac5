"""Repair of damaged conversations by divide and conquer in linear space.

A repaired conversation is empty or an optional system row and then pairs of a user
and an assistant row, by the first letters of the roles. Rows are kept, given
another role or deleted, and empty rows are inserted, at the least cost; of the
cheapest lists of edits the least in letter order is taken.

Four states tell what came last: nothing, system, user, assistant. As in
Hirschberg's alignment, the cost of the first half is carried forward and that of
the second half backward, four numbers each; they meet at the state with the least
sum, and both halves are solved alike. Beside each forward cost goes the rank of its
list of edits among the four: lists that end with the same row are no prefixes of
each other, so ranks are enough to choose the least of equal crossings, and no
list is kept.

A conversation of any length is cut into blocks. A block becomes a table of four by
four costs and ranks; tables are joined into tables of more blocks, level by
level, until one is left; crossings then come down the same tree to the blocks,
which are solved on their own. Equal rows of one turn are one item with a count, so
a conversation or a row with a third of a table is spread over many tasks. Only the
final reading of a conversation, for its texts, list of edits and SHA-256, is a
stream through one task, which keeps one byte per edit and no texts.

Defined cases: rows are taken by turn, null turns first, then by role and the hash
of the text; null roles and texts are one space, so such a text is blank; a null id
is a conversation; repeated rows are duplicates; a role that begins with none of the
letters s, u, a is legal nowhere; an empty table gives no rows; further columns are
left out. Ids are integers or texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import pinned
from chatloom.operators.scan import number_rows

BLOCK = 4096
FAN = 1024

# What counts as white space and as an end of a text, and the costs.
SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INITIALS = "sua"
# What is still inserted at the end of a conversation.
ENDING = ("", "II", "I", "")
FAR = 1 << 60

# Per state the ways on: (next state, cost, order among the ways from this state).
Step = list[list[tuple[int, int, object]]]


def asked(state: int) -> int:
    """The state after a row of the role that is due."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state after a kept row, if it may stand there."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def item_step(code: int, extra: int = 0) -> Step:
    """Ways past an item: inserts, one edit of its row, deletes of its ``extra`` repeats.

    ``code`` is 3 * initial + mark; mark 1 is a row that must go, 2 a truncated one.
    Inserts before a delete are left to what follows it, which is as cheap and less
    in letter order.
    """
    initial, mark = divmod(code, 3)
    ways = []
    for state in STATES:
        best = {state: (DELETE, "D")}
        if mark != 1:
            at = state
            for inserts in range(3):
                cost = inserts * INSERT + (TRUNCATED if mark == 2 else 0)
                for then, more, edit in ((kept(at, initial), 0, "K"), (asked(at), REROLE, "R")):
                    if then is not None:
                        found = (cost + more, "I" * inserts + edit)
                        best[then] = min(best.get(then, found), found)
                at = asked(at)
        ways.append([(then, cost + extra * DELETE, tail + "D" * extra) for then, (cost, tail) in best.items()])
    return ways


PLAIN_STEPS = [item_step(code) for code in range(12)]


def forward(steps: list[Step], entry: int, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Cost and rank of the least list of edits from ``entry`` to each state."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[entry] = 0
    for at in range(lo, hi):
        step, best = steps[at], {}
        for state in STATES:
            if (spent := cost[state]) < FAR:
                for then, more, order in step[state]:
                    found = (spent + more, rank[state], order)
                    if then not in best or found < best[then]:
                        best[then] = found
        cost, rank = [FAR] * 4, [0] * 4
        for place, (_, _, then) in enumerate(sorted((way[1], way[2], then) for then, way in best.items())):
            rank[then] = place
        for then, way in best.items():
            cost[then] = way[0]
    return cost, rank


def backward(steps: list[Step], exit_: int, lo: int, hi: int) -> list[int]:
    """Cost from each state to ``exit_``."""
    cost = [FAR] * 4
    cost[exit_] = 0
    for at in range(hi - 1, lo - 1, -1):
        step = steps[at]
        cost = [min(FAR, *[more + cost[then] for then, more, _ in step[state]]) for state in STATES]
    return cost


def crossings(steps: list[Step], entry: int, exit_: int, lo: int, hi: int) -> list[int]:
    """The states after steps lo, ..., hi - 1 on the least of the cheapest ways."""
    if hi - lo <= 1:
        return [exit_] * (hi - lo)
    middle = (lo + hi) // 2
    cost, rank = forward(steps, entry, lo, middle)
    rest = backward(steps, exit_, middle, hi)
    _, _, state = min((cost[s] + rest[s], rank[s], s) for s in STATES if cost[s] < FAR)
    return crossings(steps, entry, state, lo, middle) + crossings(steps, state, exit_, middle, hi)


def last_state(cost: list[int], rank: list[int]) -> int:
    """Where the items of a whole conversation end."""
    return min((cost[s] + INSERT * len(ENDING[s]), rank[s], s) for s in STATES if cost[s] < FAR)[2]


def edits(steps: list[Step], entry: int, exit_: int) -> tuple[str, int]:
    """The list of edits between two states, and its cost."""
    state, tails, spent = entry, [], 0
    for step, then in zip(steps, crossings(steps, entry, exit_, 0, len(steps))):
        cost, tail = next((c, order) for t, c, order in step[state] if t == then)
        tails.append(tail)
        spent += cost
        state = then
    return "".join(tails), spent


def whole(steps: list[Step]) -> tuple[str, int]:
    """Edits and cost of a whole conversation."""
    exit_ = last_state(*forward(steps, START, 0, len(steps)))
    tails, spent = edits(steps, START, exit_)
    return tails + ENDING[exit_], spent + INSERT * len(ENDING[exit_])


def table_of(steps: list[Step]) -> tuple[list[int], list[int]]:
    """Costs and ranks from each state to each, row by row."""
    found = [forward(steps, entry, 0, len(steps)) for entry in STATES]
    return [c for cost, _ in found for c in cost], [r for _, rank in found for r in rank]


def table_step(costs: list[int], ranks: list[int]) -> Step:
    return [
        [(t, int(costs[4 * s + t]), int(ranks[4 * s + t])) for t in STATES if costs[4 * s + t] < FAR] for s in STATES
    ]


def _key(column: Column) -> Column:
    """An id as text that is never null."""
    return F.when(column.isNull(), "").otherwise(F.concat(F.lit("="), column.cast("string")))


def _own_id(kind: str) -> Column:
    return F.when(F.col("_conv") != "", F.expr("substring(_conv, 2)").cast(kind))


def _spaced(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(
        _key(F.col(conv)).alias("_conv"), F.col(turn).cast("bigint").alias("_turn"),
        _spaced(F.col(role)).alias("_role"), _spaced(F.col(text)).alias("_t"),
    ).withColumn("_hash", F.unhex(F.md5("_t")))


def _items(rows: DataFrame, block: int) -> DataFrame:
    """Equal rows of a turn as one item, numbered in its conversation, with its faults."""
    seen = F.rtrim(F.col("_t"), F.lit(SPACES))
    narrow = rows.select(
        "_conv", "_turn", "_role", "_hash", (seen == "").alias("blank"), (~F.right(seen, F.lit(1)).isin(*ENDS)).alias("cut"),
    )
    counted = pinned(narrow.groupBy("_conv", "_turn", "_role", "_hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut")
    ))
    numbered = pinned(number_rows(counted, "item", ["_turn", "_role", "_hash"], ["_conv"]).drop("_turn"))
    same = ["_conv", "_role", "_hash"]
    often = numbered.groupBy(*same).agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    # AQE splits the partition of a text that fills a conversation.
    marked = numbered.join(often, same, "left")
    again = F.col("first").isNotNull() & (F.col("item") > F.col("first"))
    repeated = F.when(F.col("blank"), 0).when(again, F.col("copies")).otherwise(F.col("copies") - 1)
    mark = F.when(F.col("blank") | again, 1).when(F.col("cut"), 2).otherwise(0)
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.substring("_role", 1, 1)), F.lit(0)) - 1, F.lit(3))
    initial = F.when(F.col("_role") == "", 3).otherwise(initial)
    return marked.select(
        "_conv", F.floor(F.col("item") / block).cast("bigint").alias("block"), "item",
        (initial * 3 + mark).cast("int").alias("code"), (F.col("copies") - 1).cast("bigint").alias("extra"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).cast("bigint").alias("blank"),
        repeated.cast("bigint").alias("duplicate"), F.when(mark == 2, 1).otherwise(0).cast("bigint").alias("truncated"),
    )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each key of sorted batches, as columns."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        own = list(zip(*[columns[k] for k in keys]))
        start = 0
        for at in range(batch.num_rows + 1):
            if at == batch.num_rows or own[at] != last:
                if at > start:
                    for name, values in columns.items():
                        held.setdefault(name, []).extend(values[start:at])
                if at < batch.num_rows:
                    if held:
                        yield held
                    held, last, start = {}, own[at], at
    if held:
        yield held


def _steps(run: dict[str, list]) -> list[Step]:
    return [item_step(code, extra) if extra else PLAIN_STEPS[code] for code, extra in zip(run["code"], run["extra"])]


BLOCKS = (
    "_conv string, block bigint, edits string, cost bigint, blank bigint, duplicate bigint, "
    "truncated bigint, costs array<bigint>, ranks array<int>"
)
BLOCK_FIELDS = pa.schema([
    ("_conv", pa.string()), ("block", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()),
    ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
    ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())),
])
REMEMBERED = 20_000


def _written(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of a bounded number of rows and characters."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _dealt(items: DataFrame, *more: str) -> DataFrame:
    columns = ["_conv", "block", "item", "code", "extra", "blank", "duplicate", "truncated", *more]
    return items.select(*columns).repartition("_conv", "block").sortWithinPartitions("_conv", "block", "item")


def _solved(items: DataFrame, block: int) -> DataFrame:
    """Per block: the edits where it is a whole conversation, else its table."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[str, int]] = {}

        def each() -> Iterator[tuple]:
            for run in _runs(batches, ["_conv", "block"]):
                counts = [sum(run[name]) for name in ("blank", "duplicate", "truncated")]
                at, place = run["_conv"][0], run["block"][0]
                if place or len(run["code"]) == block:
                    yield (at, place, None, None, *counts, *table_of(_steps(run)))
                    continue
                # Short conversations repeat: what was found for one list of items holds for all.
                pattern = (*run["code"], -1, *run["extra"])
                if pattern not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[pattern] = whole(_steps(run))
                yield (at, place, *known[pattern], *counts, None, None)

        yield from _written(each(), BLOCK_FIELDS)

    return _dealt(items).mapInArrow(solve, BLOCKS)


def _joined_tables(tables: DataFrame, fan: int) -> DataFrame:
    """Tables of ``fan`` neighbours as one."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        costs, ranks = table_of([table_step(c, r) for c, r in zip(pdf["costs"], pdf["ranks"])])
        return pd.DataFrame({"_conv": [pdf["_conv"].iat[0]], "node": [pdf["node"].iat[0] // fan], "costs": [costs], "ranks": [ranks]})

    return tables.withColumn("_up", F.floor(F.col("node") / fan)).groupBy("_conv", "_up").applyInPandas(
        join, "_conv string, node bigint, costs array<bigint>, ranks array<int>"
    )


def _ways(root: DataFrame) -> DataFrame:
    """Where the one table of a conversation is entered and left."""

    @F.udf("int")
    def leave(costs, ranks):
        return last_state(costs[:4], ranks[:4])

    return root.select("_conv", "node", F.lit(START).alias("entry"), leave("costs", "ranks").alias("exit"))


def _crossed(tables: DataFrame, ways: DataFrame, fan: int) -> DataFrame:
    """Entry and exit of each table from those of the tables they were joined into."""

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        steps = [table_step(c, r) for c, r in zip(pdf["costs"], pdf["ranks"])]
        entry, exit_ = int(pdf["entry"].iat[0]), int(pdf["exit"].iat[0])
        after = crossings(steps, entry, exit_, 0, len(steps))
        return pd.DataFrame({"_conv": pdf["_conv"], "node": pdf["node"], "entry": [entry, *after[:-1]], "exit": after})

    parents = ways.withColumnRenamed("node", "_up")
    return tables.withColumn("_up", F.floor(F.col("node") / fan)).join(parents, ["_conv", "_up"]).groupBy(
        "_conv", "_up"
    ).applyInPandas(cross, "_conv string, node bigint, entry int, exit int")


def _edited(rows: DataFrame, block: int, fan: int) -> DataFrame:
    """(_conv, block, edits, cost, blank, duplicate, truncated) of every block."""
    items = pinned(_items(rows, block))
    solved = pinned(_solved(items, block))
    found = solved.drop("costs", "ranks").filter("edits IS NOT NULL")
    tables = solved.filter("edits IS NULL").select("_conv", F.col("block").alias("node"), "costs", "ranks")
    last = tables.agg(F.max("node")).first()[0]
    if last is None:
        return found
    levels = [tables]
    while last:
        levels.append(pinned(_joined_tables(levels[-1], fan)))
        last //= fan
    ways = pinned(_ways(levels[-1]))
    for level in reversed(levels[:-1]):
        ways = pinned(_crossed(level, ways, fan))
    ends = ways.groupBy("_conv").agg(F.max("node").alias("_last"))
    known = ways.join(ends, "_conv").select(
        "_conv", F.col("node").alias("block"), "entry", "exit", (F.col("node") == F.col("_last")).alias("ends")
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for run in _runs(batches, ["_conv", "block"]):
                tail = ENDING[run["exit"][0]] if run["ends"][0] else ""
                text, cost = edits(_steps(run), run["entry"][0], run["exit"][0])
                counts = [sum(run[name]) for name in ("blank", "duplicate", "truncated")]
                yield (run["_conv"][0], run["block"][0], text + tail, cost + INSERT * len(tail), *counts)

        yield from _written(each(), pa.schema(list(BLOCK_FIELDS)[:7]))

    kind = ", ".join(BLOCKS.split(", ")[:7])
    longer = _dealt(items.join(known, ["_conv", "block"]), "entry", "exit", "ends").mapInArrow(solve, kind)
    return found.unionByName(longer)


REPORT = (
    "_conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
REPORT_FIELDS = pa.schema([
    ("_conv", pa.string()), *[(name, pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])
REPAIRED = "_conv string, place bigint, turn bigint, role string, text string, edit string"
REPAIRED_FIELDS = pa.schema([
    ("_conv", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("edit", pa.string()),
])
LEGAL = {"su", "ua", "au"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


class Replay:
    """Reads one conversation's rows in order along its list of edits."""

    def __init__(self):
        self.audit, self.at, self.state = [], 0, START
        self.numbers = dict.fromkeys(("blank", "duplicate", "truncated", "cost"), 0)
        self.before, self.illegal = None, 0
        self.least = self.turn = None
        self.turns = 0

    def learn(self, row: dict) -> None:
        self.audit.append(row["edits"])
        for name in self.numbers:
            self.numbers[name] += row[name]

    def _inserted(self) -> Iterator[tuple]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = asked(self.state)
            self.at += 1
            yield (None, "assistant" if self.state == ASSISTANT else "user", "", "I")

    def read(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        """(turn, role, text, edit) of what stands up to and at this row."""
        if not self.at and isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.turn:
            self.least, self.turn, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = asked(self.state)
            role = "assistant" if self.state == ASSISTANT else "user"
        elif edit == "K":
            self.state = AFTER[role[0]]
        if edit != "D":
            yield (turn, role, text, edit)

    def end(self) -> Iterator[tuple]:
        yield from self._inserted()

    def report(self) -> tuple:
        gaps = self.turn - self.least + 1 - self.turns if self.turns else 0
        n = self.numbers
        audit = self.audit if isinstance(self.audit, str) else ""
        return (gaps, n["blank"], n["duplicate"], n["truncated"], self.illegal, n["cost"], audit)


def _read_along(
    rows: DataFrame, found: DataFrame, known: DataFrame | None,
    read: Callable[[Iterator[tuple[str, Replay, Iterator[tuple]]]], Iterator[tuple]], fields: pa.Schema, schema: str,
) -> DataFrame:
    """Stream each conversation's edits and then its rows, in order, through ``read``.

    Texts move once. ``known`` has ids that are conversations even without rows.
    """
    lists = found.withColumn("kind", F.lit(0))
    texts = rows.withColumn("kind", F.lit(1))
    both = lists.unionByName(texts, allowMissingColumns=True)
    if known is not None:
        both = both.unionByName(known.select("_conv").distinct().withColumn("kind", F.lit(2)), allowMissingColumns=True)
    dealt = both.repartition("_conv").sortWithinPartitions("_conv", "kind", "block", "_turn", "_role", "_hash").drop("_hash")
    names = ("edits", *("blank", "duplicate", "truncated", "cost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            conv, replay, state = None, None, None
            for whole_ in batches:
                for start in range(0, whole_.num_rows, 1024):
                    batch = whole_.slice(start, 1024)
                    columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
                    for at in range(batch.num_rows):
                        if columns["_conv"][at] != conv:
                            if replay is not None:
                                yield from read(conv, replay, replay.end(), state, True)
                            conv, replay, state = columns["_conv"][at], Replay(), {}
                        if columns["kind"][at] == 0:
                            replay.learn({name: columns[name][at] for name in names})
                        elif columns["kind"][at] == 1:
                            row = replay.read(columns["_turn"][at], columns["_role"][at], columns["_t"][at])
                            yield from read(conv, replay, row, state, False)
            if replay is not None:
                yield from read(conv, replay, replay.end(), state, True)

        yield from _written(each(), fields)

    return dealt.mapInArrow(run, schema)


def audit_conversations(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    known: DataFrame | None = None, block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """One row per conversation: faults, cost, edits (``audit``) and the repaired rows' SHA-256.

    ``known`` is a table whose conversations are reported even if ``rows`` has none
    of theirs.
    """
    given = _rows(rows, conv, turn, role, text)

    def read(at, replay, found, state, ends):
        digest = state.setdefault("sha", hashlib.sha256())
        for _, who, said, _ in found:
            digest.update(f"{state.get('join', '')}{who}:{said}".encode())
            state["join"] = "\n"
        if ends:
            yield (at, *replay.report(), digest.hexdigest())

    ids = None if known is None else known.select(_key(F.col(conv)).alias("_conv"))
    result = _read_along(given, _edited(given, block, fan), ids, read, REPORT_FIELDS, REPORT)
    return result.select(_own_id(rows.schema[conv].dataType.simpleString()).alias(conv), *result.columns[1:])


def repair_conversations(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """The repaired rows: id, place from 0, turn (null where inserted), role, text, edit (K, R, I)."""
    given = _rows(rows, conv, turn, role, text)

    def read(at, replay, found, state, ends):
        for row in found:
            yield (at, state.setdefault("place", 0), *row)
            state["place"] += 1

    result = _read_along(given, _edited(given, block, fan), None, read, REPAIRED_FIELDS, REPAIRED)
    return result.select(
        _own_id(rows.schema[conv].dataType.simpleString()).alias(conv), "place",
        F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "edit",
    )


def damage(
    rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Known damage by a hash of id and turn: rows that are dropped, emptied, cut, repeated, or given to the user."""
    fate = F.crc32(F.concat(_spaced(F.col(conv)), F.lit(":"), _spaced(F.col(turn)))) % 20
    said = _spaced(F.col(text))
    damaged = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    times = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(fate != 0).select(
        F.col(conv).alias(conv), F.col(turn).alias(turn),
        F.when(fate == 4, "user").otherwise(_spaced(F.col(role))).alias(role), damaged.alias(text),
        F.explode(times).alias("_time"),
    ).drop("_time")
