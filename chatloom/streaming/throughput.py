"""Training throughput over a stream of step logs.

State is one row per run (begin, last log time, highest step). A batch scans its
rows behind the state rows of its own runs with the batch operator, so a run that
dominates a batch is still cut into slices; runs without new rows are carried over
unread by the scan. The state has two generations, the batch's and its
predecessor's: a replayed batch starts from what it began with and overwrites its
own output, and nothing piles up. Rows of a run must arrive in time order across
batches, as one training run writes them; inside a batch they are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from chatloom import schemas
from chatloom.operators.throughput import STATE_COLUMNS, next_state, throughput

OUTPUT_COLUMNS = (
    "run_id BIGINT, log_id BIGINT, step BIGINT, tokens_per_sec DOUBLE, "
    "tokens_per_sec_avg DOUBLE, batch_id BIGINT"
)


def read_log_stream(
    spark: SparkSession, path: str, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schemas.TRAIN_LOG)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_throughput(
    log: DataFrame, tokens_in_step: int, target: str, state: str, checkpoint: str
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        known, idle = None, None
        if batch_id > 0:
            before = spark.read.schema(STATE_COLUMNS).parquet(f"{state}/slot={(batch_id - 1) % 2}")
            active = batch.select("run_id").distinct()
            known = before.join(active, "run_id", "left_semi")
            idle = before.join(active, "run_id", "left_anti")
        rows = throughput(batch, tokens_in_step, known)
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        after = next_state(batch, known)
        after = after if idle is None else after.unionByName(idle)
        after.write.mode("overwrite").parquet(f"{state}/slot={batch_id % 2}")
        batch.unpersist()

    return (
        log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_throughput(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(OUTPUT_COLUMNS).parquet(target).drop("batch_id")
