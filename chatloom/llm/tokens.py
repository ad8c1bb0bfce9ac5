"""Token ids in binary files, as a Spark data source.

Ids are replaced by their rank in the corpus, the most frequent one first, and ranks
are written in as few bytes as they need: a control byte holds the byte counts of
four ranks in two bits each, the data bytes follow in an area of their own. A table
of 256 masks says for each control byte which of the sixteen bytes of four ranks were
written, so numpy packs and unpacks a whole block by one lookup and one masked copy.

A folder holds

* ``ids-<name>.bin``: magic number, blocks of control bytes then data bytes, an index
  (document ids, which of them are null, numbers of ids; blocks' ids and data bytes),
  and its place, document count and block count as the last 32 bytes with the magic
  number again;
* ``ranks-<name>.bin``: the id of each rank, unsigned 32-bit little-endian;
* ``manifest.json``: the files in document order with their counts. It is written
  last, when all tasks have ended, so files of lost or repeated tasks are never read.

Texts are encoded and their ids counted in one pass; what is stored and sorted are ids
in two or four bytes each. Documents are dealt out by slices of the document id, so
files are in its ascending order, null ids first, and where a file's documents start
is a sum over the manifest. A task writes and reads a block at a time. The driver sees
a few arrays of the vocabulary's size and one entry per file.

Defined cases: a null text counts as empty and is the end token alone; rows of one
document id follow each other as they are stored, whatever their number, and are
documents of their own; an empty table gives a manifest without files; further
columns are ignored. Files go to any file system that pyarrow opens by the folder's
address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage,
)

from chatloom.llm.common import buckets_of
from chatloom.llm.packing import ChunkEncoder, tokenizer_path
from chatloom.operators.scan import slice_starts, starts_at_or_before
from chatloom.session import fresh_folder

FORMAT = "chatloom_tokens"
END_ID = 2
BLOCK_IDS = 1 << 18
# Ids of two bytes leave room for more chunks than those of packing.
CACHED_CHUNKS = 300_000
MAGIC = b"TOKENS01"
ENCODED = "doc_id bigint, ids binary, counts binary"
COUNTING_TASKS = 8
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

# Which of the four bytes of each of four ranks a control byte says are written.
CONTROL = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
MASKS = np.arange(4) <= CONTROL[:, :, None]


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype="<u4")
    padded[:len(ranks)] = ranks
    sizes = (padded >= 1 << 8).astype(np.uint8) + (padded >= 1 << 16) + (padded >= 1 << 24)
    four = sizes.reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    used = MASKS[control].reshape(-1, 4)[:len(ranks)]
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[:len(ranks)][used].tobytes()


def unpack_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The numbers back, by table lookup."""
    used = MASKS[np.frombuffer(control, dtype=np.uint8)].reshape(-1, 4)[:count]
    found = np.zeros((count, 4), dtype=np.uint8)
    found[used] = np.frombuffer(data, dtype=np.uint8)
    return found.reshape(-1).view("<u4")


def _opened(path: str):
    """File system and path of a folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _read(path: str, name: str) -> bytes:
    system, folder = _opened(path)
    with system.open_input_file(f"{folder}/{name}") as file:
        return file.read()


def _write(path: str, name: str, content: bytes) -> None:
    """Write a small file whole: it is there completely or not at all."""
    system, folder = _opened(path)
    system.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as file:
        file.write(content)
    system.move(part, f"{folder}/{name}")


@dataclass
class Written(WriterCommitMessage):
    """A task's file; ``first`` is the sort key of its first document."""

    name: str | None
    first: tuple
    documents: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Writes (doc_id, _place, ids) in the order given, one file per task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.ranks, self.width = options["path"], options["ranks"], options["width"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = (batch for batch in iterator if batch.num_rows)
        head = next(batches, None)
        if head is None:
            return Written(None, (), 0, 0)
        first = head.slice(0, 1).to_pylist()[0]
        ids_by_rank = np.frombuffer(_read(self.path, self.ranks), dtype="<u4")
        rank_of = np.zeros(int(ids_by_rank.max()) + 1, dtype="<u4")
        rank_of[ids_by_rank] = np.arange(len(ids_by_rank), dtype="<u4")
        name = f"ids-{uuid.uuid4().hex}.bin"
        documents, nulls, lengths, blocks = [], [], [], []
        system, folder = _opened(self.path)
        with system.open_output_stream(f"{folder}/{name}") as file:
            file.write(MAGIC)
            place, held, count = len(MAGIC), [], 0

            def flush() -> None:
                nonlocal place, held, count
                ranks = np.concatenate(held)
                for at in range(0, len(ranks), BLOCK_IDS):
                    part = ranks[at:at + BLOCK_IDS]
                    control, data = pack_ranks(part)
                    file.write(control)
                    file.write(data)
                    blocks.append((len(part), len(data)))
                    place += len(control) + len(data)
                held, count = [], 0

            for whole in (b for more in ([head], batches) for b in more):
                # A few documents at a time: a batch of long ones is not held twice.
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    own = batch.column("doc_id")
                    documents.append(own.fill_null(0).to_numpy(zero_copy_only=False))
                    nulls.append(own.is_null().to_numpy(zero_copy_only=False))
                    found = batch.column("ids").to_pylist()
                    size = np.dtype(self.width).itemsize
                    lengths.append(np.array([len(x) // size for x in found], dtype="<i8"))
                    held.append(rank_of[np.frombuffer(b"".join(found), dtype=self.width)])
                    count += len(held[-1])
                    if count >= BLOCK_IDS:
                        flush()
            if count:
                flush()
            counted = np.concatenate(lengths)
            for part in (np.concatenate(documents).astype("<i8"), np.concatenate(nulls).astype(np.uint8), counted, np.array(blocks, dtype="<i8")):
                file.write(part.tobytes())
            file.write(np.array([place, len(counted), len(blocks)], dtype="<i8").tobytes() + MAGIC)
        key = (first["doc_id"] is not None, first["doc_id"] or 0, first["_place"])
        return Written(name, key, len(counted), int(counted.sum()))

    def commit(self, messages: list[Written | None]) -> None:
        start, files = 0, []
        for message in sorted((m for m in messages if m and m.name), key=lambda m: m.first):
            files.append({"name": message.name, "start": start, "documents": message.documents, "ids": message.ids})
            start += message.ids
        _write(self.path, "manifest.json", json.dumps({"ranks": self.ranks, "ids": start, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _opened(self.path)
        for message in messages:
            if message and message.name:
                system.delete_file(f"{folder}/{message.name}")


@dataclass
class TokenFile(InputPartition):
    name: str
    start: int


class TokenReader(DataSourceReader):
    """Documents of the files named in the manifest, a file per partition."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.manifest = json.loads(_read(self.path, "manifest.json"))

    def partitions(self) -> list[TokenFile]:
        # Spark asks for one partition at least.
        return [TokenFile(f["name"], f["start"]) for f in self.manifest["files"]] or [TokenFile("", 0)]

    def read(self, partition: TokenFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        ids_by_rank = np.frombuffer(_read(self.path, self.manifest["ranks"]), dtype="<u4")
        system, folder = _opened(self.path)
        with system.open_input_file(f"{folder}/{partition.name}") as file:
            size = file.size()
            end = file.read_at(32, size - 32)
            if end[24:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
                raise ValueError(f"{partition.name} is not a token file")
            place, count, blocks = np.frombuffer(end[:24], dtype="<i8").tolist()
            index = file.read_at(size - 32 - place, place)
            documents = np.frombuffer(index, "<i8", count)
            nulls = np.frombuffer(index, np.uint8, count, 8 * count).astype(bool)
            lengths = np.frombuffer(index, "<i8", count, 9 * count)
            sizes = np.frombuffer(index, "<i8", 2 * blocks, 17 * count).reshape(-1, 2)
            starts = partition.start + np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at, done, left = len(MAGIC), 0, b""
            for ids, data in sizes.tolist():
                control = -(-ids // 4)
                block = file.read_at(control + data, at)
                at += control + data
                left += ids_by_rank[unpack_ranks(block[:control], block[control:], ids)].astype("<u4").tobytes()
                # The documents that end in what has been read.
                ends = np.cumsum(lengths[done:done + len(left) // 4 + 1])
                whole = int(np.searchsorted(ends, len(left) // 4, side="right"))
                if not whole:
                    continue
                cuts = [0, *(4 * ends[:whole]).tolist()]
                part = slice(done, done + whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(documents[part], mask=nulls[part]), pa.array(starts[part]), pa.array(lengths[part]),
                        pa.array([left[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                done, left = done + whole, left[cuts[-1]:]


class TokenSource(DataSource):
    """``spark.read.format("chatloom_tokens")`` once ``register`` has been called."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options)

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenSource)


def encode(docs: DataFrame, path: str, *, id: str, text: str, end_id: int, width: str) -> DataFrame:
    """(doc_id, ids, counts): the ids of whole texts with the end id, in ``width``; and from
    each task one row more, with how often each id occurs as 64-bit integers."""
    rows = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("_t"))
    end = np.array([end_id], dtype=width).tobytes()
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, width, CACHED_CHUNKS)
        total = np.zeros(0, dtype="<i8")
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [x + end for x in encoder([x or "" for x in batch.column("_t").to_pylist()])]
                found = np.bincount(np.frombuffer(b"".join(ids), dtype=width), minlength=len(total))
                found[:len(total)] += total
                total = found
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names
                )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names
        )

    return rows.mapInArrow(run, ENCODED)


def frequencies(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs, from the tasks' counts, which are added up in a few tasks."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype="<i8")
        for batch in batches:
            for part in batch.column("counts").to_pylist():
                total = _sum(total, np.frombuffer(part, dtype="<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    few = encoded.filter("counts IS NOT NULL").select("counts").coalesce(COUNTING_TASKS).mapInArrow(added, "counts binary")
    total = np.zeros(0, dtype="<i8")
    for row in few.toLocalIterator():
        total = _sum(total, np.frombuffer(bytes(row["counts"]), dtype="<i8"))
    return total


def _sum(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The sum of two arrays of counts, the shorter one filled up."""
    whole = np.zeros(max(len(one), len(other)), dtype="<i8")
    whole[:len(one)] += one
    whole[:len(other)] += other
    return whole


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, *, id: str = "doc_id", text: str = "text", end_id: int = END_ID,
) -> None:
    """Tokenise whole texts and write them to ``path`` in ascending order of the integer id."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path()
    highest = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab().values())
    width = "<u2" if highest < 1 << 16 else "<u4"
    # Ids in few distinct values: compressed, a stored table is smaller than a checkpoint.
    stored = fresh_folder(spark, "token-ids")
    encode(docs, tokenizer, id=id, text=text, end_id=end_id, width=width).write.option("compression", "zstd").parquet(stored)
    encoded = spark.read.schema(ENCODED).parquet(stored)
    counts = frequencies(encoded)
    # The most frequent id first, of equally frequent ones the least; ids that do not occur have no rank.
    ranked = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)]
    ranks = f"ranks-{uuid.uuid4().hex}.bin"
    _write(path, ranks, ranked.astype("<u4").tobytes())
    # The place in the stored rows cuts even repeated rows of one id.
    order = ["doc_id", "_place"]
    keyed = encoded.withColumn("_place", F.monotonically_increasing_id()).filter("counts IS NULL").select(*order, "ids")
    count = buckets_of(spark)
    starts, found = slice_starts(keyed, order, count)
    own = F.struct(*order).cast(keyed.select(*order).schema.simpleString())
    placed = keyed.withColumn("_slice", starts_at_or_before(starts, found, own))
    dealt = placed.repartitionById(count, F.col("_slice")).sortWithinPartitions(*order).drop("_slice")
    register(spark)
    dealt.write.format(FORMAT).mode("append").options(path=path, ranks=ranks, width=width).save()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids are unsigned 32-bit little-endian; start counts all ids before."""
    register(spark)
    return spark.read.format(FORMAT).load(path)
