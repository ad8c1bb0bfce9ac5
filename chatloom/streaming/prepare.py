"""Incremental preparation: new chat rows in, training chats out.

A row is a whole chat, or one of ``parts`` parts of a longer one. Parts may arrive
in different batches. What has come of a chat is kept as keyed state, the number of
each part and the source file it stands in; texts are read again from those files
once the chat is complete. So a batch costs what has arrived and what is complete
with it, not what waits. Each waiting chat has a timer: if parts are still missing
when it ends, those that came are set aside with their counts, and the state goes.
Times are those Spark logs for a batch, and files are written per batch, so a
replayed batch gives the same rows. Source files must stay until their chats are done.
Parts without a number or a chat are set aside at once.

State needs Spark's RocksDB store, which is set for the stream alone. A timer ends
with the first batch that has new rows after its time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chatloom import schemas
from chatloom.operators.keyindex import KeyIndex
from chatloom.operators.resume import not_done
from chatloom.plans.prepare import Funnel, prepare_chats
from chatloom.sources.readers import read_if_present

WAIT_SECONDS = 86_400
# Chats of more parts are prepared turn by turn and never become one row.
WHOLE_PARTS = 16

EVENTS = "source_idx BIGINT, outcome STRING, parts BIGINT, came BIGINT, files ARRAY<STRING>"
INCOMPLETE = "source_idx BIGINT, parts BIGINT, came BIGINT"
FUNNEL = "outcome STRING, chats BIGINT"
STREAM_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # With timers on the clock there would always be one more batch without rows.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def read_chat_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.CHAT_ROWS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class Waiting(StatefulProcessor):
    """Which parts of a chat have come, and from which file."""

    def __init__(self, wait_seconds: int):
        self.wait_seconds = wait_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.came = handle.getMapState("came", "part BIGINT", "file STRING")
        self.total = handle.getValueState("total", "parts BIGINT, came BIGINT, timer BIGINT")

    def _event(self, key: tuple, outcome: str, parts: int, files: dict[int, str]) -> pd.DataFrame:
        return pd.DataFrame({
            "source_idx": [key[0]], "outcome": [outcome], "parts": [parts], "came": [len(files)],
            "files": [sorted(set(files.values()))],
        })

    def _end(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.came.clear()
        self.total.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, str] = {}
        parts = 0
        for pdf in rows:
            for part, of, file in zip(pdf["part"].tolist(), pdf["parts"].tolist(), pdf["file"].tolist()):
                new.setdefault(int(part), file)
                parts = max(parts, int(of))
        if len(new) >= parts and not self.total.exists():
            # The usual case: all parts come together, and no state is written.
            yield self._event(key, "complete", parts, new)
            return
        timer, known = None, 0
        if self.total.exists():
            before, known, timer = self.total.get()
            parts = max(parts, before)
        for part, file in new.items():
            if not self.came.containsKey((part,)):
                self.came.updateValue((part,), (file,))
                known += 1
        if known >= parts:
            yield self._event(key, "complete", parts, {k[0]: v[0] for k, v in self.came.iterator()})
            self._end(timer)
            return
        if timer is None:
            timer = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.wait_seconds
            self.handle.registerTimer(timer)
        self.total.update((parts, known, timer))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = self.total.get()[0]
        yield self._event(key, "incomplete", parts, {k[0]: v[0] for k, v in self.came.iterator()})
        self._end(None)

    def close(self) -> None:
        pass


def _with_events(chats: DataFrame, wait_seconds: int) -> DataFrame:
    """Whole chats as rows, a row for each chat of parts that is complete or given up,
    and parts without a number or a chat, which can be placed nowhere."""
    parts = chats.filter("parts > 1 AND part IS NOT NULL AND source_idx IS NOT NULL").select(
        "source_idx", "part", "parts", F.col("_metadata.file_path").alias("file")
    )
    events = parts.groupBy("source_idx").transformWithStateInPandas(
        Waiting(wait_seconds), EVENTS, "append", "processingTime"
    )
    whole = chats.filter("coalesce(parts, 1) <= 1").select(*schemas.CHAT_ROWS.fieldNames())
    unplaced = chats.filter("parts > 1 AND (part IS NULL OR source_idx IS NULL)").select(
        *schemas.CHAT_ROWS.fieldNames(), F.lit("unplaced").alias("outcome")
    )
    return whole.unionByName(events, allowMissingColumns=True).unionByName(unplaced, allowMissingColumns=True)


def _parts_of(events: DataFrame, outcome: str, files: list[str]) -> DataFrame:
    """The parts of the chats of an outcome, from the files they stand in."""
    chosen = events.filter(F.col("outcome") == outcome).select("source_idx", F.col("parts").alias("_parts"))
    stored = events.sparkSession.read.schema(schemas.CHAT_ROWS).parquet(*[unquote(file) for file in files])
    return stored.filter("parts > 1 AND part IS NOT NULL").join(chosen, "source_idx")


def _joined(parts: DataFrame) -> DataFrame:
    """Chats of few parts as whole rows: one shuffle, and a row no longer than the parts allow."""
    ordered = F.sort_array(F.collect_list(F.struct("part", "messages", "num_tokens")))
    once = F.filter("_all", lambda x, i: (i == 0) | (x["part"] != F.get("_all", i - 1)["part"]))
    rows = parts.groupBy("source_idx").agg(ordered.alias("_all")).withColumn("_all", once)
    return rows.select(
        "source_idx", F.flatten(F.transform("_all", lambda x: x["messages"])).alias("messages"),
        F.get("_all", F.lit(0))["num_tokens"].alias("num_tokens"),
    )


def _foreach_batch(
    chats: DataFrame, target: str, checkpoint: str, wait_seconds: int,
    write: Callable[[DataFrame, DataFrame | None, DataFrame, int], None],
) -> StreamingQuery:
    """``write`` takes a batch's whole chats, the parts of its long ones (or None), the
    keys of both, and the batch's number."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        events = batch.filter("outcome IS NOT NULL")
        # Three rows at most; the files are among those the stream's source has listed.
        known = {
            r["outcome"]: r for r in events.select("outcome", "parts", F.explode_outer("files").alias("file"))
            .groupBy("outcome").agg(F.collect_set("file").alias("files"), F.max("parts").alias("most")).collect()
        }
        whole, long = batch.filter("outcome IS NULL").select("source_idx", "messages", "num_tokens"), None
        if done := known.get("complete"):
            parts = _parts_of(events, "complete", done["files"])
            whole = whole.unionByName(_joined(parts.filter(F.col("_parts") <= WHOLE_PARTS)))
            if done["most"] > WHOLE_PARTS:
                long = parts.filter(F.col("_parts") > WHOLE_PARTS).drop("_parts").dropDuplicates(["source_idx", "part"])
        if "unplaced" in known:
            unplaced = batch.filter("outcome = 'unplaced'").select(*schemas.CHAT_ROWS.fieldNames())
            unplaced.write.mode("overwrite").parquet(f"{target}-incomplete/unplaced/batch_id={batch_id}")
        if lost := known.get("incomplete"):
            left = _parts_of(events, "incomplete", lost["files"]).drop("_parts")
            left.select(*schemas.CHAT_ROWS.fieldNames()).write.mode("overwrite").parquet(f"{target}-incomplete/rows/batch_id={batch_id}")
            counts = events.filter("outcome = 'incomplete'").select("source_idx", "parts", "came")
            counts.write.mode("overwrite").parquet(f"{target}-incomplete/chats/batch_id={batch_id}")
        write(whole, long, batch.filter("coalesce(outcome, 'complete') = 'complete'").select("source_idx"), batch_id)
        batch.unpersist()

    spark = chats.sparkSession
    before = {key: spark.conf.get(key, None) for key in STREAM_SETTINGS}
    for key, value in STREAM_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        # The stream takes its settings along when it starts.
        return (
            _with_events(chats, wait_seconds).writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _prepared(whole: DataFrame, long: DataFrame | None, funnel: Funnel | None, options: dict) -> DataFrame:
    rows = prepare_chats(whole, seen=funnel, **options)
    return rows if long is None else rows.unionByName(prepare_chats(long, seen=funnel, **options))


def stream_prepare(
    chats: DataFrame, target: str, checkpoint: str, wait_seconds: int = WAIT_SECONDS,
    funnel: bool = False, **options,
) -> StreamingQuery:
    """Process what has arrived and stop. The plan is that of the batch; each batch
    has a folder of its own, which a replay overwrites. With ``funnel`` the chats per
    outcome of each batch, counted while it is written, go to ``<target>-funnel``."""

    def write(whole: DataFrame, long: DataFrame | None, _: DataFrame, batch_id: int) -> None:
        seen = Funnel() if funnel else None
        _prepared(whole, long, seen, options).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        if seen is not None:
            counts = whole.sparkSession.createDataFrame(sorted(seen.chats().items()), FUNNEL)
            counts.coalesce(1).write.mode("overwrite").parquet(f"{target}-funnel/batch_id={batch_id}")

    return _foreach_batch(chats, target, checkpoint, wait_seconds, write)


def read_prepared_stream(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(schemas.PREPARED_CHATS).parquet(target).select(*schemas.PREPARED_CHATS.fieldNames())


def read_stream_funnel(spark: SparkSession, target: str) -> DataFrame:
    """Chats per outcome over all batches."""
    counts = spark.read.schema(FUNNEL).parquet(f"{target}-funnel")
    return counts.groupBy("outcome").agg(F.sum("chats").alias("chats"))


def read_incomplete(spark: SparkSession, target: str) -> DataFrame:
    """Chats that were given up: how many parts they have and how many came."""
    counts = read_if_present(spark, f"{target}-incomplete/chats", schemas.struct(INCOMPLETE))
    return spark.createDataFrame([], INCOMPLETE) if counts is None else counts.select("source_idx", "parts", "came")


def stream_resume(
    chats: DataFrame, target: str, checkpoint: str, wait_seconds: int = WAIT_SECONDS, **options,
) -> StreamingQuery:
    """Like ``stream_prepare`` into a table other runs have also written: each
    batch leaves out keys the target holds, so a replayed batch adds nothing. The
    keys are asked of an index beside the target, so a batch reads the key columns
    of files added since and the bits of its own keys."""
    schema = schemas.PREPARED_CHATS
    index = KeyIndex(chats.sparkSession, target, f"{target}-keys", schema, "source_idx", dense=True)

    def write(whole: DataFrame, long: DataFrame | None, keys: DataFrame, _: int) -> None:
        index.refresh()
        finished = index.finished(keys)
        fresh = [None if rows is None else not_done(rows, finished, "source_idx") for rows in (whole, long)]
        _prepared(*fresh, None, options).write.mode("append").parquet(target)

    return _foreach_batch(chats, target, checkpoint, wait_seconds, write)
