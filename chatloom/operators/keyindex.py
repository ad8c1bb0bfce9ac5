"""An index of the keys a table holds: what is finished, without reading the table.

Each bucket of keys has a bitmap of 32,768 bits, built by bitmap aggregates and
merged by OR. For dense integer keys (row numbers) a bucket is a run of 32,768
keys and a bit is a key, so the bitmap is the answer. Any other key sets ``PROBES``
bits of its hash bucket, a Bloom filter; keys it lets through are looked up in the
bucket's stored keys, so the answer is exact either way. Both are sorted by bucket:
Parquet statistics leave out what a batch does not touch.

The index keeps the names of the files it covers. Files it does not know yet,
whoever wrote them, are added before it answers, by their key columns alone; if a
covered file is gone, or the index is lost, it is built again from the table. Each
addition is a folder of its own whose note is written last, so a lost or repeated
job leaves nothing behind that counts; setting a bit twice changes nothing. Many
additions are merged into one.

Null keys are never in the index.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chatloom.sources.notes import folders, read_note, write_note
from chatloom.sources.readers import read_if_present

# Fixed value: the bits of a bitmap.
BITS = 32_768
PROBES = 7
# At this many keys a filter lets about one other key in a hundred through.
KEYS_PER_FILTER = 3_000
LEAST_BUCKETS = 64
MOST_PARTS = 32
FILES_PER_TASK = 16
NOTE = "covers.json"
BITMAPS = "bucket BIGINT, bits BINARY"


def _bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has the bit at a position."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class KeyIndex:
    """Finished keys of the Parquet table at ``target``, indexed at ``path``.

    ``dense`` is for one integer key whose values lie close together.
    """

    def __init__(
        self, spark: SparkSession, target: str, path: str, schema: T.StructType, *keys: str,
        dense: bool = False, most_parts: int = MOST_PARTS,
    ):
        if dense and (len(keys) != 1 or not isinstance(schema[keys[0]].dataType, T.IntegralType)):
            raise ValueError("a dense index has one integer key")
        self.spark, self.target, self.path, self.keys = spark, target, path, list(keys)
        self.schema = T.StructType([schema[key] for key in keys])
        self.dense, self.most_parts = dense, most_parts
        # Committed additions by name; other processes' are found when the index is opened.
        self.parts = self._committed()

    def _committed(self) -> dict[str, dict]:
        found = {}
        for name in folders(self.spark, self.path):
            note = read_note(self.spark, f"{self.path}/{name}/{NOTE}")
            if note is not None:
                found[name] = json.loads(note)
        replaced = {name for note in found.values() for name in note["replaces"]}
        return {name: note for name, note in found.items() if name not in replaced}

    def _buckets(self) -> int:
        return max([LEAST_BUCKETS, *(note["buckets"] for note in self.parts.values())])

    def _placed(self, rows: DataFrame, buckets: int) -> DataFrame:
        """Keys with their bucket and the positions of their bits."""
        if self.dense:
            key = F.col(self.keys[0]).cast("bigint")
            return rows.select(*self.keys, F.bitmap_bucket_number(key).alias("bucket"), F.array(F.bitmap_bit_position(key)).alias("at"))
        probes = [F.pmod(F.xxhash64(F.lit(probe), *self.keys), F.lit(BITS)) for probe in range(PROBES)]
        return rows.select(*self.keys, F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).alias("bucket"), F.array(*probes).alias("at"))

    def _store(self, keys: DataFrame, files: list[str], buckets: int, replaces: list[str]) -> None:
        """Index keys as one addition that covers the files."""
        name = f"{len(self.parts):06d}-{uuid.uuid4().hex}"
        tasks = 1 + len(files) // FILES_PER_TASK
        sorted_by_bucket = lambda df: df.repartitionByRange(tasks, "bucket").sortWithinPartitions("bucket")
        placed = self._placed(keys, buckets)
        bits = placed.select("bucket", F.explode("at").alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
        sorted_by_bucket(bits).write.parquet(f"{self.path}/{name}/bits")
        if not self.dense:
            sorted_by_bucket(placed.drop("at")).write.parquet(f"{self.path}/{name}/keys")
        note = {"files": files, "buckets": buckets, "replaces": replaces}
        write_note(self.spark, f"{self.path}/{name}/{NOTE}", json.dumps(note))
        self.parts = {k: v for k, v in self.parts.items() if k not in replaces} | {name: note}

    def refresh(self) -> list[str]:
        """Cover the target's files as they are now; the files that were read."""
        table = read_if_present(self.spark, self.target, self.schema)
        names = set() if table is None else set(table.inputFiles())
        covered = {name for note in self.parts.values() for name in note["files"]}
        stale = covered - names
        new = sorted(names if stale else names - covered)
        if stale and not new:
            self._store(self.spark.createDataFrame([], self.schema), [], self._buckets(), list(self.parts))
        elif new:
            read = table if len(new) == len(names) else self.spark.read.schema(self.schema).parquet(*new)
            self._store(read.dropna(), new, self._buckets(), list(self.parts) if stale else [])
        if len(self.parts) > self.most_parts:
            self.merge()
        return new

    def _read(self, kind: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{kind}" for name in sorted(self.parts)])

    def merge(self) -> None:
        """All additions as one; filters get as many buckets as their keys need now."""
        files = sorted(name for note in self.parts.values() for name in note["files"])
        old = list(self.parts)
        if not self.dense:
            stored = self._read("keys", self.schema)
            buckets = max(LEAST_BUCKETS, 1 << (stored.count() // KEYS_PER_FILTER).bit_length())
            self._store(stored.distinct(), files, buckets, old)
            return
        name = f"{len(self.parts):06d}-{uuid.uuid4().hex}"
        merged = self._read("bits", BITMAPS).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        merged.repartitionByRange(1 + len(files) // FILES_PER_TASK, "bucket").sortWithinPartitions("bucket").write.parquet(f"{self.path}/{name}/bits")
        note = {"files": files, "buckets": LEAST_BUCKETS, "replaces": old}
        write_note(self.spark, f"{self.path}/{name}/{NOTE}", json.dumps(note))
        self.parts = {name: note}

    def finished(self, rows: DataFrame) -> DataFrame:
        """The distinct keys of ``rows`` that the target holds, as of the last refresh."""
        asked = rows.select(*self.keys).dropna().distinct()
        found = [self._finished(asked, buckets) for buckets in sorted({note["buckets"] for note in self.parts.values()})]
        found = [keys for keys in found if keys is not None]
        if not found:
            return asked.filter(F.lit(False))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()

    def _finished(self, asked: DataFrame, buckets: int) -> DataFrame | None:
        placed = self._placed(asked, buckets)
        span = placed.agg(F.min("bucket"), F.max("bucket")).first()
        if span[0] is None:
            return None
        touched = F.col("bucket").between(*span)
        of = [name for name, note in sorted(self.parts.items()) if note["buckets"] == buckets]
        read = lambda kind, schema: self.spark.read.schema(schema).parquet(
            *[f"{self.path}/{name}/{kind}" for name in of]
        ).filter(touched)
        bits = read("bits", BITMAPS).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        held = placed.join(bits, "bucket").filter(F.forall("at", lambda at: _bit(F.col("bits"), at)))
        if self.dense:
            return held.select(*self.keys)
        stored = read("keys", T.StructType([T.StructField("bucket", T.LongType()), *self.schema.fields]))
        return held.select("bucket", *self.keys).join(stored, ["bucket", *self.keys], "left_semi").select(*self.keys)
