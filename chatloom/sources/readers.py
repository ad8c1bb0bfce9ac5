"""Readers. Every schema is declared; nothing is inferred at run time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatloom import schemas


def read_table(
    spark: SparkSession, path: str, subset: str | None = None, split: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Parquet table; subset and split are partition columns, so they prune files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    for column, value in (("subset", subset), ("split", split)):
        if value is not None:
            table = table.filter(F.col(column) == value)
    return table


def read_jsonl(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, strict: bool = False
) -> DataFrame:
    """JSON lines with a declared schema; ``strict`` fails on a broken line."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def read_prepared(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_jsonl(spark, paths, schemas.PREPARED_CHATS, strict=True)


def _whole_number(text: Column) -> Column:
    """An integer, or a decimal cut towards zero; null for anything else."""
    number = text.try_cast("double")
    towards_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(text.try_cast("bigint"), towards_zero.try_cast("bigint"))


def read_if_present(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, kind: str = "parquet", **options
) -> DataFrame | None:
    """The table, or None when its path does not exist."""
    try:
        return spark.read.schema(schema).format(kind).options(**options).load(paths)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _read_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    schema = T.StructType([T.StructField(key, T.StringType())])
    keys = read_if_present(spark, path, schema, "json")
    return spark.createDataFrame([], schema) if keys is None else keys


def read_done_indices(spark: SparkSession, path: str, key: str = "source_idx") -> DataFrame:
    """Finished row indices. Broken lines and lines without a usable key are
    ignored, numeric texts count, and an absent path means nothing is done."""
    keys = _read_keys(spark, path, key).select(_whole_number(F.col(key)).alias(key))
    return keys.dropna().distinct()


def read_done_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """Finished text ids, under the same tolerance."""
    return _read_keys(spark, path, key).dropna().distinct()


def read_shards(
    spark: SparkSession, root: str, schema: T.StructType, extension: str = ".jsonl", line: str | None = None,
    files: list[str] | None = None,
) -> DataFrame | None:
    """All shards ``<root>.rank<r><ext>`` (files or folders) as one table, tagged
    with shard name and rank; None when there is no shard.

    With ``line`` a column of that name holds the text of each broken line, and
    ``_file`` and ``_block`` say where a row was read. With ``files`` only those
    of the shards' files are read.
    """
    paths = f"{root}.rank*{extension}" if files is None else files
    if line is None:
        table = read_if_present(spark, paths, schema, "json")
    else:
        table = read_if_present(spark, paths, T.StructType([T.StructField("value", T.StringType())]), "text")
    if table is None:
        return None
    name = F.regexp_extract("_metadata.file_path", r"([^/]*\.rank\d+[^/]*)", 1)
    if line is None:
        return tag_rank(table.withColumn("shard", name))
    wide = T.StructType([*schema.fields, T.StructField(line, T.StringType())])
    parsed = F.from_json("value", wide, {"columnNameOfCorruptRecord": line})
    return tag_rank(table.select(
        parsed.alias("_row"), name.alias("shard"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).select("_row.*", "shard", "_file", "_block"))


def tag_rank(table: DataFrame, name: str = "shard") -> DataFrame:
    rank = F.regexp_extract(name, r"\.rank(\d+)", 1).try_cast("int")
    return table.withColumn("rank", rank)


def shard_name(root: Column, rank: Column, extension: Column) -> Column:
    return F.concat(root, F.lit(".rank"), rank.cast("string"), extension)


def peek(df: DataFrame, n: int = 10) -> DataFrame:
    """A look at some rows, the table's columns being ``df.columns``."""
    return df.limit(n)
