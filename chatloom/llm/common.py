"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from chatloom.session import shared_folder

BUCKET = "_bucket"


def buckets_of(spark: SparkSession) -> int:
    """Buckets a hot group is cut into: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pinned(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the cluster's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hash_bucket(count: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(count)).cast("int")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], value: Column, out: str
) -> DataFrame:
    """Exclusive running sum of ``value`` per key, in the order (bucket, *order).

    ``df`` has a column ``_bucket`` that no later row of a key decreases, and no
    null keys. A key's rows meet only within one bucket; between buckets only one
    sum per (key, bucket) moves, so a key with a third of all rows is cut into as
    many tasks as there are buckets. ``df`` is read twice: pin costly columns.
    """
    place = [*keys, BUCKET]
    totals = df.groupBy(*place).agg(F.sum(value).alias("_in_bucket"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *place, F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        df.join(carry, place)
        .withColumn(out, (F.col("_carry") + before).cast("bigint"))
        .drop("_carry")
    )


def skewed_join(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int | None = None
) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row per key, whatever a key's share.

    ``weight`` is a column of the table: how many rows a key has; ``total`` is their
    sum, where the caller knows it or a bound near it. Keys with at
    least a quarter of a partition's fair share of all weights are joined by
    broadcast: by that definition they are at most four times as many as there
    are partitions, so they are read first and no branch is planned for keys that
    do not exist. All other keys are too small to skew a shuffle. The table is read
    up to three times, and rows twice where there are hot keys; pin what is costly.
    """
    spark = rows.sparkSession
    parts = buckets_of(spark)
    if total is None:
        total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * (4 * parts) >= F.lit(total)
    plain = table if weight in keys else table.drop(weight)
    few = table.filter(hot).select(*plain.columns).collect()
    if not few:
        return rows.join(plain, keys)
    known = spark.createDataFrame(few, plain.schema).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(known), keys, "left")
    easy = marked.filter("_hot").drop("_hot")
    rest = marked.filter("_hot IS NULL").select(*rows.columns).join(table.filter(~hot).select(*plain.columns), keys)
    return easy.unionByName(rest)
