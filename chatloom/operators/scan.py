"""Ordered scans (running sums, maxima, row numbers) that survive one hot group.

A window over one group, or over the whole table, would run in one task. Rows are
therefore cut into slices that are contiguous in the full order key, so a group
with a third of all rows spans many slices. Each slice is scanned on its own and
gets the carry of the earlier slices. Only the first group of a slice can have
begun earlier: there are fewer carry rows than slices, whatever the data, so the
carry is safe to broadcast.

Where the slices begin is read off a weighted sample of the order key, which one
narrow job takes without a count: each task puts its rows into a fixed number of
random lots and keeps one row per lot and the lot's size. The slice number is then
an expression of the row, found by halving among the sorted starts, so a row costs
the logarithm of the number of slices, a lost task works it out again and nothing
has to be stored. All rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

SLICE = "_slice"
SAMPLED_PER_SLICE = 60
LOTS_PER_TASK = 400


@dataclass(frozen=True)
class Slices:
    """Rows ready for an ordered scan."""

    rows: DataFrame
    group: list[str]
    order: list[str]

    @property
    def keys(self) -> list[str]:
        return [SLICE, *self.group]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def with_carry(
        self, parts: dict[str, tuple[Column, Callable[[Column], Column]]]
    ) -> DataFrame:
        """Add, per name, its value over the group's rows in earlier slices (or null).

        ``parts`` maps a name to the aggregate inside one slice and the function
        that merges slices, such as ``(F.count("*"), F.sum)``.
        """
        totals = self.rows.groupBy(*self.keys).agg(
            *[inside.alias(name) for name, (inside, _) in parts.items()]
        )
        earlier = (
            Window.partitionBy(*(self.group or [F.lit(0)]))
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = totals.select(
            *self.keys,
            F.count(F.lit(1)).over(earlier).alias("_earlier"),
            *[merge(F.col(name)).over(earlier).alias(name) for name, (_, merge) in parts.items()],
        ).filter("_earlier > 0").drop("_earlier")
        carry = carry.withColumnsRenamed({key: f"{key}_of_carry" for key in self.keys})
        same = [F.col(key).eqNullSafe(F.col(f"{key}_of_carry")) for key in self.keys]
        joined = self.rows.join(F.broadcast(carry), same, "left")
        return joined.drop(*[f"{key}_of_carry" for key in self.keys])


def starts_at_or_before(starts: Column, count: int, own: Column) -> Column:
    """How many of ``count`` ascending starts are at most ``own``, in as many steps as count has bits."""
    if not count:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(count.bit_length()))])

    def place(key: Column) -> Column:
        further = lambda at, step: F.when(F.get(starts, at + step - F.lit(1)) <= key, at + step).otherwise(at)
        return F.aggregate(steps, F.lit(0), further)

    # As a lambda's argument the key is made once per row, not once per step.
    return F.get(F.transform(F.array(own), place), F.lit(0))


def _weighted_sample(df: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """One row: the sampled keys in order, each with the rows it stands for and as texts.

    A task keeps at most as many rows as it has lots. Tasks are about as many as there
    are slices; where there are fewer, each has more lots.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    lots = max(LOTS_PER_TASK, SAMPLED_PER_SLICE * slices // tasks)
    drawn = df.select(
        *keys, F.spark_partition_id().alias("_task"), F.floor(F.rand(1) * lots).cast("int").alias("_lot"), F.rand(2).alias("_draw")
    )
    # One aggregate per column: numbers and times then need no sort.
    kept = drawn.groupBy("_task", "_lot").agg(
        *[F.min_by(key, "_draw").alias(key) for key in keys], F.count(F.lit(1)).alias("_rows")
    )
    texts = [F.hex(field.name) if _in_hex(field) else F.col(field.name).cast("string") for field in df.select(*keys).schema]
    return kept.agg(F.sort_array(F.collect_list(
        F.struct(F.struct(*keys).alias("key"), F.col("_rows").alias("rows"), F.array(*texts).alias("texts"))
    )).alias("sample"))


def _in_hex(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BinaryType))


def _literal(texts: list[str | None], schema: T.StructType) -> str:
    """A sampled key as SQL; letters and bytes as hexadecimal digits, so nothing has to be escaped."""
    values = []
    for text, field in zip(texts, schema):
        plain = "NULL" if text is None else f"X'{text}'" if _in_hex(field) else f"'{text}'"
        values.append(f"CAST({plain} AS {field.dataType.simpleString()})")
    return f"struct({', '.join(values)})"


def slice_starts(df: DataFrame, keys: list[str], slices: int) -> tuple[Column, int]:
    """Up to ``slices`` - 1 keys, evenly spread over the table's rows, as an array of structs.

    The sample decides only where slices begin, never what a scan returns.
    """
    sample = _weighted_sample(df, keys, slices).first()["sample"]
    total, before, starts = sum(row["rows"] for row in sample), 0, []
    for row in sample:
        # This key begins the next slice once its share of the rows lies before it.
        if before and len(starts) < slices - 1 and before * slices >= (len(starts) + 1) * total:
            starts.append(row["texts"])
        before += row["rows"]
    schema = df.select(*keys).schema
    # One expression, folded to one literal, however many starts there are.
    made = F.expr(f"array({', '.join(_literal(texts, schema) for texts in starts)})")
    return made.cast(f"array<{schema.simpleString()}>"), len(starts)


def slice_rows(
    df: DataFrame, order: list[str], group: list[str] | None = None, slices: int | None = None
) -> Slices:
    """Number the slices: how many of them begin at or before the row's key."""
    group = group or []
    keys = [*group, *order]
    count = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, found = slice_starts(df, keys, count)
    own = F.struct(*keys).cast(df.select(*keys).schema.simpleString())
    return Slices(df.withColumn(SLICE, starts_at_or_before(starts, found, own)), group, order)


def running_sums(
    df: DataFrame, values: dict[str, Column], order: list[str], group: list[str] | None = None, **slicing
) -> DataFrame:
    """Exclusive running sums in ``order``, per group or over the table, one per name."""
    sliced = slice_rows(df.withColumns({f"_value_{out}": value for out, value in values.items()}), order, group, **slicing)
    carried = sliced.with_carry({f"_carry_{out}": (F.sum(f"_value_{out}"), F.sum) for out in values})
    before = sliced.window().rowsBetween(Window.unboundedPreceding, -1)
    totals = {
        out: F.coalesce(f"_carry_{out}", F.lit(0)) + F.coalesce(F.sum(f"_value_{out}").over(before), F.lit(0)) for out in values
    }
    return carried.select(*df.columns, *[total.alias(out) for out, total in totals.items()])


def running_sum(
    df: DataFrame, value: Column, out: str, order: list[str], group: list[str] | None = None, **slicing
) -> DataFrame:
    """Exclusive running sum of ``value`` in ``order``, per group or over the table."""
    return running_sums(df, {out: value}, order, group, **slicing)


def number_rows(
    df: DataFrame, out: str, order: list[str], group: list[str] | None = None, **slicing
) -> DataFrame:
    """Row number from 0 in ``order``: assign it once at ingest and store it."""
    return running_sum(df, F.lit(1).cast("bigint"), out, order, group, **slicing)
