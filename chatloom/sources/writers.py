"""Writers. Appends are idempotent when they go through ``append_new``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from chatloom import schemas
from chatloom.operators.keyindex import KeyIndex
from chatloom.operators.resume import not_done
from chatloom.sources.notes import file_sizes, read_note, write_note
from chatloom.sources.readers import read_if_present, read_shards


def append_jsonl(df: DataFrame, path: str, run: str | None = None) -> None:
    """Append rows as JSON lines, text as UTF-8. Rows of a named run replace those a
    failed attempt of the same run has left."""
    df.write.mode("append" if run is None else "overwrite").json(path if run is None else f"{path}/run={run}")


def append_generations(generations: DataFrame, path: str, run: str | None = None) -> None:
    """One line per problem and pass; the pass number stays with the row."""
    append_jsonl(generations.select("id", "title", "generation", "pass_idx"), path, run)


def append_new(
    df: DataFrame,
    path: str,
    schema: T.StructType,
    *keys: str,
    transform: Callable[[DataFrame], DataFrame] = lambda fresh: fresh,
    index: KeyIndex | None = None,
) -> None:
    """Append transform(rows whose key the target does not hold yet); safe to repeat.

    An ``index`` of the target's keys is brought up to date and asked for the rows'
    keys; without one all keys of the target are read.
    """
    if index is not None:
        index.refresh()
        df = not_done(df, index.finished(df), *keys)
    elif (written := read_if_present(df.sparkSession, path, schema)) is not None:
        df = not_done(df, written, *keys)
    transform(df).write.mode("append").parquet(path)


def write_shards(
    df: DataFrame, path: str, shards: int, *keys: str, files_per_shard: int | None = None
) -> None:
    """One folder per shard. Rows are assigned by key, so a rerun gives the same
    shards; give the row's full key, which no hot value can dominate. A shard has
    as many files as its share of the shuffle partitions."""
    if files_per_shard is None:
        files_per_shard = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    slot = F.pmod(F.xxhash64(*keys), F.lit(shards * files_per_shard)).cast("int")
    placed = df.withColumn("_slot", slot).repartitionById(shards * files_per_shard, F.col("_slot"))
    ranked = placed.withColumn("rank", F.col("_slot") % shards).drop("_slot")
    ranked.write.mode("overwrite").partitionBy("rank").json(path)


def first_of_each(shards: DataFrame, key: str) -> DataFrame:
    """The first row of each key by rank and stored place in the shard; rows without a key stay.

    A place is the file, the block of the file and the order inside the block, as
    they were stored when the shard was parsed.
    """
    placed = shards.withColumn("_place", F.struct("rank", "_file", "_block", "_order"))
    first = placed.groupBy(key).agg(F.min("_place").alias("_first"))
    kept = placed.join(first, key, "left").filter(F.col("_first").isNull() | (F.col("_place") == F.col("_first")))
    return kept.drop("_place", "_first")


PARSED = T.StructType([
    *schemas.PREPARED_CHATS.fields, T.StructField("_line", T.StringType()), T.StructField("shard", T.StringType()),
    T.StructField("_file", T.StringType()), T.StructField("_block", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("_order", T.LongType()),
])


def parse_shards(spark: SparkSession, root: str, staged: str, extension: str, check: Callable[[DataFrame], None]) -> DataFrame | None:
    """All shards' rows and broken lines from a columnar stage, to which files not parsed yet are added.

    A note in the stage tells the files it holds with their sizes and is written
    last. If one of them has changed or is gone, the stage begins anew. ``check``
    sees new rows before they count. None without shards.
    """
    sizes = file_sizes(spark, f"{root}.rank*{extension}")
    if not sizes:
        return None
    noted = read_note(spark, f"{staged}/files.json")
    held = json.loads(noted) if noted else {"files": {}, "parts": []}
    if any(sizes.get(name) != size for name, size in held["files"].items()):
        held = {"files": {}, "parts": []}
    new = sorted(set(sizes) - set(held["files"]))
    if new:
        part = f"{staged}/part-{uuid.uuid4().hex}"
        rows = read_shards(spark, root, schemas.PREPARED_CHATS, extension, line="_line", files=new)
        rows.withColumn("_order", F.monotonically_increasing_id()).write.parquet(part)
        check(spark.read.schema(PARSED).parquet(part))
        held = {"files": sizes, "parts": [*held["parts"], part]}
        write_note(spark, f"{staged}/files.json", json.dumps(held))
    return spark.read.schema(PARSED).parquet(*held["parts"])


def finalize_shards(
    spark: SparkSession, root: str, target: str, dedup: bool = False, broken: str = "fail",
    extension: str = ".jsonl",
) -> DataFrame | None:
    """Merge shards into one columnar table; without shards the existing table is
    used, and with neither nothing happens.

    Each shard file is parsed once, into ``<target>-parsed``; a later merge reads
    the files that have come since. A torn or otherwise broken line fails the merge;
    with ``broken="aside"`` such lines go to ``<target>-broken`` with their shard
    instead. ``dedup`` keeps the first row of each source_idx.
    """
    if broken not in ("fail", "aside"):
        raise ValueError(f"broken must be 'fail' or 'aside', not {broken!r}")

    def check(rows: DataFrame) -> None:
        if broken == "fail" and (count := rows.filter("_line IS NOT NULL").count()):
            raise ValueError(f"{count} broken lines in the shards of {root}")

    shards = parse_shards(spark, root, f"{target}-parsed", extension, check)
    if shards is not None:
        if broken == "aside":
            save_table(shards.filter("_line IS NOT NULL").select("shard", "rank", F.col("_line").alias("line")), f"{target}-broken")
        else:
            check(shards)
        rows = shards.filter("_line IS NULL")
        rows = first_of_each(rows, "source_idx") if dedup else rows
        save_table(rows.select(*schemas.PREPARED_CHATS.fieldNames()), target)
    return read_if_present(spark, target, schemas.PREPARED_CHATS)


def save_table(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_log(rows: DataFrame, path: str, run: str | None = None) -> None:
    """Append evaluation-log rows (a row or a few per run) to the log table. A named
    run's rows replace those of an earlier attempt, so a retry adds nothing."""
    few = rows.select(*schemas.EVAL_LOG.fieldNames()).coalesce(1).write
    few.mode("append").parquet(path) if run is None else few.mode("overwrite").parquet(f"{path}/run={run}")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_repair_results(results: DataFrame, path: str) -> None:
    results.select(*schemas.REPAIR_RESULTS.fieldNames()).write.mode("overwrite").json(path)
