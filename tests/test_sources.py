from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from chatloom import schemas
from chatloom.functions import chat
from chatloom.sources import prompts, readers, writers


def prepared(spark, keys, language="python"):
    data = [([{"role": "user", "content": f"é{k}"}], language, 5, k) for k in keys]
    return spark.createDataFrame(data, schemas.PREPARED_CHATS)


def keys_of(df, key="source_idx"):
    return sorted(r[key] for r in df.collect())


def test_tolerant_keys(spark, tmp_path):
    lines = ['{"source_idx": 1}', '{"source_idx": 2', '{"other": 4}', '{"source_idx": "7"}',
             '{"source_idx": 3.9}', '{"source_idx": 1}', "", "text", '{"source_idx": null}',
             '{"source_idx": -2.5}', '{"source_idx": "x"}']
    path = tmp_path / "done.jsonl"
    path.write_text("\n".join(lines))
    assert keys_of(readers.read_done_indices(spark, str(path))) == [-2, 1, 3, 7]


def test_an_absent_file_means_nothing_is_done(spark, tmp_path):
    assert readers.read_done_indices(spark, str(tmp_path / "none")).count() == 0
    assert readers.read_done_ids(spark, str(tmp_path / "none")).count() == 0


def test_finished_ids(spark, tmp_path):
    path = tmp_path / "gens.jsonl"
    path.write_text('{"id": "p1", "generation": "x"}\nbroken\n{"id": "p1"}\n{"title": "t"}\n{"id": "p2"}\n')
    assert keys_of(readers.read_done_ids(spark, str(path)), "id") == ["p1", "p2"]


def test_shards_come_with_name_and_rank(spark, tmp_path):
    for rank in (0, 1, 10):
        line = {"messages": [], "language": "cpp", "num_tokens_serialized": 1, "source_idx": rank}
        (tmp_path / f"data.rank{rank}.jsonl").write_text(json.dumps(line) + "\n")
    (tmp_path / "data.jsonl").write_text('{"source_idx": 99}\n')
    shards = readers.read_shards(spark, f"{tmp_path}/data", schemas.PREPARED_CHATS)
    got = [tuple(r) for r in shards.orderBy("shard").select("shard", "rank", "source_idx").collect()]
    assert got == [("data.rank0.jsonl", 0, 0), ("data.rank1.jsonl", 1, 1), ("data.rank10.jsonl", 10, 10)]
    assert readers.read_shards(spark, f"{tmp_path}/other", schemas.PREPARED_CHATS) is None


def test_shard_name(spark):
    name = readers.shard_name(F.lit("out/data"), F.lit(3), F.lit(".jsonl"))
    assert spark.range(1).select(name).first()[0] == "out/data.rank3.jsonl"


def test_jsonl_keeps_text_and_an_empty_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    writers.append_jsonl(prepared(spark, [1]), path)
    writers.append_jsonl(prepared(spark, []), path)
    writers.append_jsonl(prepared(spark, [2]), path)
    back = readers.read_prepared(spark, path)
    assert back.schema == schemas.PREPARED_CHATS and keys_of(back) == [1, 2]
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert "é1" in written


def test_a_broken_line_fails_the_strict_reader(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"source_idx": 1\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILFAST"):
        readers.read_prepared(spark, str(tmp_path / "bad.jsonl")).collect()


def test_finalize(spark, tmp_path):
    root, target = f"{tmp_path}/data", f"{tmp_path}/merged"
    assert writers.finalize_shards(spark, root, target) is None
    writers.append_jsonl(prepared(spark, [1, 2]), f"{root}.rank0.jsonl")
    writers.append_jsonl(prepared(spark, [2, 3]), f"{root}.rank1.jsonl")
    assert keys_of(writers.finalize_shards(spark, root, target)) == [1, 2, 2, 3]
    assert keys_of(writers.finalize_shards(spark, root, target, dedup=True)) == [1, 2, 3]
    assert keys_of(writers.finalize_shards(spark, f"{tmp_path}/none", target)) == [1, 2, 3]


def test_the_first_shards_row_stays_and_torn_lines_are_set_aside(spark, tmp_path):
    root, target = f"{tmp_path}/data", f"{tmp_path}/merged"
    line = '{"messages": [], "language": "%s", "num_tokens_serialized": 1, "source_idx": %s}'
    (tmp_path / "data.rank0.jsonl").write_text("\n".join([line % ("a", 1), line % ("b", 1), line % ("n", "null"), line % ("n", "null")]))
    (tmp_path / "data.rank2.jsonl").write_text("\n".join([line % ("c", k) for k in (1, 2)] + ['{"messages": [{"role": "us']))
    (tmp_path / "data.rank10.jsonl").write_text("\n".join([line % ("d", k) for k in (2, 3)]))
    with pytest.raises(ValueError, match="1 broken line"):
        writers.finalize_shards(spark, root, target)
    for _ in range(3):
        merged = writers.finalize_shards(spark, root, target, dedup=True, broken="aside")
        got = sorted((str(r["source_idx"]), r["language"]) for r in merged.collect())
        assert got == [("1", "a"), ("2", "c"), ("3", "d"), ("None", "n"), ("None", "n")]
    torn = spark.read.parquet(f"{target}-broken").collect()
    assert [(r["rank"], r["line"]) for r in torn] == [(2, '{"messages": [{"role": "us')]
    assert writers.finalize_shards(spark, root, target, broken="aside").count() == 8


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    for keys in ([1, 2], [2, 3], [1, 2, 3]):
        writers.append_new(prepared(spark, keys), path, schemas.PREPARED_CHATS, "source_idx")
    assert keys_of(spark.read.parquet(path)) == [1, 2, 3]


def test_write_shards_is_deterministic(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = prepared(spark, range(40))
    writers.write_shards(rows, path, 4, "source_idx")
    first = sorted(map(tuple, spark.read.json(path).select("rank", "source_idx").collect()))
    writers.write_shards(rows.repartition(7), path, 4, "source_idx")
    again = sorted(map(tuple, spark.read.json(path).select("rank", "source_idx").collect()))
    assert first == again and len(first) == 40 and len({r for r, _ in first}) == 4
    assert all(len(list(p.glob("part-*"))) <= 2 for p in (tmp_path / "s").glob("rank=*"))


def test_subset_and_split_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(8).select("id", (F.col("id") % 2).cast("string").alias("subset"), F.lit("train").alias("split"))
    writers.save_table(df, path, "subset", "split")
    picked = readers.read_table(spark, path, subset="1", split="train")
    assert picked.count() == 4
    assert "PartitionFilters: [isnotnull(subset" in picked._jdf.queryExecution().executedPlan().toString()


def test_struct_of_arrays_and_back(spark):
    rows = prepared(spark, [1, 2])
    wide = rows.withColumn("m", chat.as_struct_of_arrays(F.col("messages")))
    assert wide.schema["m"].dataType.simpleString() == "struct<role:array<string>,content:array<string>>"
    back = wide.withColumn("back", chat.as_array_of_structs(F.col("m")))
    assert back.filter("back <> messages").count() == 0


def test_prompt_registry(spark):
    table = {(r["name"], r["version"]): r["text"] for r in prompts.prompt_table(spark).collect()}
    assert len(table) == len(prompts.REGISTRY) == 6
    df = spark.createDataFrame([(1, "current"), (2, "previous")], "i INT, version STRING")
    got = {r["i"]: r["system_text"] for r in prompts.with_system_text(df, "solve").collect()}
    assert got == {1: prompts.SOLVE_SYSTEM, 2: prompts.SOLVE_SYSTEM_PREVIOUS}
    for version in ("unknown", None):
        odd = spark.createDataFrame([(3, version)], "i INT, version STRING")
        with pytest.raises(Exception, match="no solve prompt of version"):
            prompts.with_system_text(odd, "solve").collect()


def test_peek(spark):
    assert readers.peek(spark.range(100), 3).count() == 3


def test_a_second_merge_parses_new_shards_only(spark, tmp_path):
    root, target = f"{tmp_path}/data", f"{tmp_path}/merged"
    line = '{"messages": [], "language": "%s", "num_tokens_serialized": 1, "source_idx": %s}\n'
    (tmp_path / "data.rank0.jsonl").write_text(line % ("a", 1) + line % ("a", 2))
    first = writers.finalize_shards(spark, root, target, dedup=True)
    assert keys_of(first) == [1, 2]
    # The same length with other content: a parser that came by would notice.
    length = (tmp_path / "data.rank0.jsonl").stat().st_size
    (tmp_path / "data.rank0.jsonl").write_text("x" * length)
    (tmp_path / "data.rank1.jsonl").write_text(line % ("b", 2) + line % ("b", 3))
    second = writers.finalize_shards(spark, root, target, dedup=True)
    assert sorted((r["source_idx"], r["language"]) for r in second.collect()) == [(1, "a"), (2, "a"), (3, "b")]
    # A shard of another length is another shard: the stage begins anew.
    (tmp_path / "data.rank0.jsonl").write_text(line % ("c", 7))
    assert keys_of(writers.finalize_shards(spark, root, target)) == [2, 3, 7]
    (tmp_path / "data.rank1.jsonl").unlink()
    assert keys_of(writers.finalize_shards(spark, root, target)) == [7]


def test_a_repeated_append_of_a_run_adds_nothing(spark, tmp_path):
    for _ in range(2):
        writers.append_jsonl(prepared(spark, [1, 2]), f"{tmp_path}/out", run="a")
    writers.append_jsonl(prepared(spark, [3]), f"{tmp_path}/out", run="b")
    assert keys_of(readers.read_prepared(spark, f"{tmp_path}/out")) == [1, 2, 3]
