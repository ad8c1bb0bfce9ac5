from __future__ import annotations

import time

from pyspark.sql import functions as F

from chatloom import schemas
from chatloom.operators.throughput import throughput
from chatloom.operators.chats import assemble_chats
from chatloom.plans.prepare import Funnel, funnel, prepare_chats, prepare_turns, profile_turns
from chatloom.streaming import prepare as stream_prepare
from chatloom.streaming import throughput as stream_throughput
from test_scan import LOG, log_rows

CODE = "<think>t</think>```py\nx\n```"


def chats(spark, keys):
    data = [(k, [{"role": "user", "content": f"q{k}"}, {"role": "assistant", "content": CODE}], None, None, None) for k in keys]
    return spark.createDataFrame(data, schemas.CHAT_ROWS)


def rows(df):
    return sorted(map(tuple, df.select("source_idx", "language", "num_tokens_serialized").collect()))


def test_stream_equals_batch_and_takes_only_new_files(spark, tmp_path):
    folder = str(tmp_path)
    for keys in (range(10), range(10, 25)):
        chats(spark, keys).write.mode("append").parquet(f"{folder}/in")
        stream = stream_prepare.read_chat_stream(spark, f"{folder}/in", files_per_batch=3)
        stream_prepare.stream_prepare(stream, f"{folder}/out", f"{folder}/check", language="python").awaitTermination()
    out = stream_prepare.read_prepared_stream(spark, f"{folder}/out")
    assert rows(out) == rows(prepare_chats(chats(spark, range(25)), "python"))


def test_resume_against_a_table_written_by_others(spark, tmp_path):
    folder = str(tmp_path)
    prepare_chats(chats(spark, range(0, 20, 2))).write.parquet(f"{folder}/out")
    chats(spark, range(20)).write.parquet(f"{folder}/in")
    for replay in ("a", "b"):
        stream = stream_prepare.read_chat_stream(spark, f"{folder}/in")
        stream_prepare.stream_resume(stream, f"{folder}/out", f"{folder}/{replay}").awaitTermination()
    out = spark.read.schema(schemas.PREPARED_CHATS).parquet(f"{folder}/out")
    assert rows(out) == rows(prepare_chats(chats(spark, range(20))))


def test_throughput_stream_equals_batch(spark, tmp_path):
    folder, log = str(tmp_path), log_rows(1200)
    for start in range(0, len(log), 500):
        part = spark.createDataFrame(log[start:start + 500], LOG).select(*schemas.TRAIN_LOG.fieldNames())
        part.write.mode("append").parquet(f"{folder}/in")
        stream_throughput.stream_throughput(
            stream_throughput.read_log_stream(spark, f"{folder}/in"), 1000,
            f"{folder}/out", f"{folder}/state", f"{folder}/check",
        ).awaitTermination()
    got = stream_throughput.read_throughput(spark, f"{folder}/out")
    want = throughput(spark.createDataFrame(log, LOG), 1000)
    assert sorted(got.collect()) == sorted(want.collect())
    # Two generations of state, whatever the number of batches.
    slots = spark.read.parquet(f"{folder}/state").select("slot").distinct().collect()
    assert sorted(r[0] for r in slots) == [0, 1]


def test_parts_of_a_chat_may_come_in_different_batches(spark, tmp_path):
    """Tiny parts, a replayed last batch, whole chats in between: the uncut answer."""
    turns = spark.createDataFrame(
        [(k, t, "assistant" if t % 2 else "user", CODE if t % 2 else f"q{k}.{t}") for k in range(12) for t in range(2 + k % 5)],
        schemas.CHAT_TURNS,
    )
    parts = assemble_chats(turns, part_bytes=150).withColumn("num_tokens", F.lit(None).cast("bigint"))
    parts = parts.withColumns({c: F.when(F.col("parts") > 1, F.col(c)) for c in ("part", "parts")})
    folder, want = str(tmp_path), rows(prepare_turns(turns))
    parts = parts.select(*schemas.CHAT_ROWS.fieldNames()).cache()
    for first, last in ((0, 0), (1, 3), (4, 99)):
        some = parts.filter(F.coalesce("part", F.lit(0)).between(first, last))
        some.write.mode("append").parquet(f"{folder}/in")
        for kind in ("out", "again"):
            stream = stream_prepare.read_chat_stream(spark, f"{folder}/in", files_per_batch=3)
            run = stream_prepare.stream_prepare if kind == "out" else stream_prepare.stream_resume
            run(stream, f"{folder}/{kind}", f"{folder}/check-{kind}").awaitTermination()
    assert rows(stream_prepare.read_prepared_stream(spark, f"{folder}/out")) == want
    assert rows(spark.read.parquet(f"{folder}/again")) == want
    parts.unpersist()


def long_turns(spark, chats, turns):
    return spark.createDataFrame(
        [(k, t, "assistant" if t % 2 else "user", CODE if t % 2 else f"q{k}.{t}") for k in chats for t in range(turns)],
        schemas.CHAT_TURNS,
    )


def in_parts(turns, part_bytes=150):
    parts = assemble_chats(turns, part_bytes=part_bytes).withColumn("num_tokens", F.lit(None).cast("bigint"))
    return parts.select(*schemas.CHAT_ROWS.fieldNames())


def test_chats_of_many_parts_are_prepared_turn_by_turn(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_prepare, "WHOLE_PARTS", 3)
    folder, turns = str(tmp_path), long_turns(spark, range(4), 6).unionByName(long_turns(spark, range(4, 7), 16))
    in_parts(turns).repartition(5).write.parquet(f"{folder}/in")
    for kind, run in (("out", stream_prepare.stream_prepare), ("again", stream_prepare.stream_resume)):
        stream = stream_prepare.read_chat_stream(spark, f"{folder}/in", files_per_batch=2)
        run(stream, f"{folder}/{kind}", f"{folder}/check-{kind}").awaitTermination()
        assert rows(spark.read.schema(schemas.PREPARED_CHATS).parquet(f"{folder}/{kind}")) == rows(prepare_turns(turns))


def test_parts_that_never_come_are_set_aside_after_their_time(spark, tmp_path):
    folder, turns = str(tmp_path), long_turns(spark, range(6), 6)
    parts = in_parts(turns).cache()

    def step(some, wait_seconds):
        some.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = stream_prepare.read_chat_stream(spark, f"{folder}/in")
        stream_prepare.stream_prepare(stream, f"{folder}/out", f"{folder}/check", wait_seconds).awaitTermination()

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    lost = parts.limit(2).withColumn("part", F.lit(None).cast("bigint"))
    step(parts.filter("part = 0 AND source_idx = 5").unionByName(lost), 3600)
    assert spark.read.parquet(f"{folder}/out-incomplete/unplaced").count() == 2
    # A repeated part is no other part.
    step(parts.filter("part = 0 AND source_idx < 5").unionByName(parts.filter("part = 0 AND source_idx < 2")), 1)
    assert stream_prepare.read_incomplete(spark, f"{folder}/out").count() == 0
    time.sleep(1)
    step(parts.filter("part > 0 AND source_idx = 5").unionByName(chats(spark, [50]).select(*parts.columns)), 3600)
    given_up = stream_prepare.read_incomplete(spark, f"{folder}/out").collect()
    cut = parts.filter("source_idx = 0").first()["parts"]
    assert cut > 2 and sorted(map(tuple, given_up)) == [(k, cut, 1) for k in range(5)]
    aside = spark.read.parquet(f"{folder}/out-incomplete/rows")
    assert {(r["source_idx"], r["part"]) for r in aside.collect()} == {(k, 0) for k in range(5)}
    want = prepare_turns(turns.filter("source_idx = 5")).unionByName(prepare_chats(chats(spark, [50])))
    assert rows(stream_prepare.read_prepared_stream(spark, f"{folder}/out")) == rows(want)
    # The session's own settings are as before.
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    parts.unpersist()


def test_the_run_that_writes_counts_its_funnel(spark, tmp_path):
    turns = long_turns(spark, range(9), 4).unionByName(spark.createDataFrame(
        [(k, 0, "user" if k % 2 else "assistant", "no code") for k in range(20, 27)], schemas.CHAT_TURNS
    ))
    want = {r["outcome"]: r["chats"] for r in funnel(profile_turns(turns), "python").collect()}
    seen = Funnel()
    prepare_turns(turns, "python", seen=seen).write.parquet(f"{tmp_path}/out")
    assert seen.chats() == want and set(want) == {"kept", "no_code", "no_reply"}


def test_a_funnel_of_which_nothing_is_left(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Funnel, "PATIENCE", 1.0)
    turns = long_turns(spark, range(5), 4)
    for number, options in enumerate(({"language": "cpp"}, {"max_seq_len": 1})):
        seen = Funnel()
        prepare_turns(turns, seen=seen, **options).write.parquet(f"{tmp_path}/{number}")
        assert seen.chats() == ({"other_language": 5}, {"too_long": 5})[number]


def test_stream_batches_count_their_funnel(spark, tmp_path):
    folder = str(tmp_path)
    in_parts(long_turns(spark, range(8), 4)).repartition(4).write.parquet(f"{folder}/in")
    chats(spark, range(30, 35)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = stream_prepare.read_chat_stream(spark, f"{folder}/in", files_per_batch=2)
    stream_prepare.stream_prepare(stream, f"{folder}/out", f"{folder}/check", funnel=True).awaitTermination()
    assert [tuple(r) for r in stream_prepare.read_stream_funnel(spark, f"{folder}/out").collect()] == [("kept", 13)]
