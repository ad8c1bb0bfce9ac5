"""Best-two-fit packing of tokenised documents into sequences of fixed length.

A bin is filled greedily with the longest pieces that fit. If it then holds more
than one piece and a gap is left, its smallest piece makes way for two unpacked
ones that fill the widened gap more tightly, where such a pair exists.

What a bin looks like depends only on which lengths are left, so the packing is
worked out on the histogram of lengths, which has at most ``max_tokens`` rows
whatever the corpus holds: a bin's pattern repeats until one of its lengths runs
short. The pieces then find their places through their rank within their length;
a length with a third of all pieces is ranked bucket by bucket.

Defined cases: a null text counts as empty and an empty text is the end token
alone; repeated rows are documents of their own; an empty table gives no rows;
documents with the same id are told apart by rank only; further columns of the
input are ignored, unless named in ``keep``.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chatloom.llm.common import BUCKET, buckets_of, hash_bucket, pinned, running_total

MAX_TOKENS = 2048
END_ID = 0
CACHED_CHUNKS = 128_000

# Where all characters are of these kinds, the tokenizer's own splitting of a
# lower-cased text is what PARTS finds, and stops and commas that touch no other
# mark stand alone.
PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-įı-ž–—‘-”•…€]*")
PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
TOUCHING = re.compile(r"[.,](?:(?=[^\w\s]|_)|(?<=[^\w\s][.,])|(?<=_[.,]))")

# Byte-level vocabularies write the bytes without a visible character of their
# own as the characters from 256 on, in order.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_NAMES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(VISIBLE)))}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks(dict):
    """Ids by chunk, worked out when first asked for.

    When full, it begins anew and keeps the last generation aside, so chunks in use stay.
    """

    def __init__(self, tokenizer, code: str, most: int):
        super().__init__()
        self.tokenizer, self.model, self.code, self.most = tokenizer, tokenizer.model, code, most
        self.older: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> list[int]:
        if chunk.isascii() and chunk.isalpha():
            return [token.id for token in self.model.tokenize(chunk.lower())]
        if PLAIN.fullmatch(chunk):
            parts = [chunk] if chunk.isalpha() else PARTS.findall(chunk.lower())
            return [
                token.id for part in parts
                for token in self.model.tokenize(part.lower().encode().decode("latin-1").translate(BYTE_NAMES))
            ]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def __missing__(self, chunk: str) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            ids = self._ids(chunk)
            found = struct.pack(f"<{len(ids)}{self.code}", *ids)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = found
        return found


class ChunkEncoder:
    """Ids of whole texts as little-endian unsigned integers of 32 bits, or of ``width``.

    The tokenizer never joins characters across white space, so a text's ids are
    those of its white-space-free chunks, and chunks repeat. The cache is bounded and
    ends with its task: a reused Python worker must not keep it for later stages.
    """

    def __init__(self, path: str, width: str = "<u4", most: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.width = width
        self.chunks = Chunks(Tokenizer.from_file(path), np.dtype(width).char, most or CACHED_CHUNKS)

    def __call__(self, texts: list[str]) -> list[bytes]:
        known, found = self.chunks.__getitem__, []
        for text in texts:
            # The names of tokens, and what is white space to Python alone.
            if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
                ids = self.chunks.tokenizer.encode(text, add_special_tokens=False).ids
                found.append(np.array(ids, dtype=self.width).tobytes())
                continue
            if PLAIN.fullmatch(text):
                text = text.lower()
                if not TOUCHING.search(text):
                    text = text.replace(".", " . ").replace(",", " , ")
            found.append(b"".join(map(known, text.split())))
        return found


def tokenize(
    docs: DataFrame, path: str, *, id: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] = (), max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids: id, piece, start, length, ids, *keep.

    ``ids`` is binary: unsigned 32-bit little-endian. Each document ends with id 0.
    """
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *keep)
    fields = [rows.schema["_id"], *[rows.schema[k] for k in keep]]
    schema = T.StructType([
        *fields, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    end = np.array([END_ID], dtype="<u4").tobytes()
    step = 4 * max_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                encoded = encode([x or "" for x in batch.column("_text").to_pylist()])
                row, piece, ids = [], [], []
                for i, got in enumerate(encoded):
                    got += end
                    for k, start in enumerate(range(0, len(got), step)):
                        row.append(i)
                        piece.append(k)
                        ids.append(got[start:start + step])
                taken = batch.drop_columns(["_text"]).take(pa.array(row, pa.int64()))
                piece = np.array(piece, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *taken.columns, pa.array(piece), pa.array(piece.astype(np.int64) * max_tokens),
                        pa.array(np.array([len(x) // 4 for x in ids], dtype=np.int64)), pa.array(ids, pa.binary()),
                    ],
                    names=[*taken.schema.names, "piece", "start", "length", "ids"],
                )

    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id)


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Best-two-fit on a histogram: (lengths with their number in the bin, bins)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in counts.items():
        left[length] = count
    places = np.arange(capacity + 1)

    def longest(most: int) -> int:
        """The longest piece left of at most ``most``; 0 if there is none."""
        found = np.flatnonzero(left[1:most + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while (first := longest(capacity)):
        bin_, gap = [], capacity
        while gap and (length := longest(min(gap, first))):
            fit = min(gap // length, int(left[length]))
            bin_ += [length] * fit
            left[length] -= fit
            gap -= fit * length
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            # below[x]: the longest piece left of at most x.
            below = np.maximum.accumulate(np.where(left > 0, places, 0))
            one = np.flatnonzero(left[1:room] > 0) + 1
            other = below[np.minimum(one, room - one)]
            twice = (other == one) & (left[one] < 2)
            other = np.where(twice, below[np.maximum(one - 1, 0)], other)
            filled = np.where(other > 0, one + other, 0)
            if len(one) and filled.max() > smallest:
                best = len(one) - 1 - int(np.argmax(filled[::-1]))
                left[smallest] += 1
                pair = [int(one[best]), int(other[best])]
                bin_ = [*bin_[:-1], *pair]
                for length in pair:
                    left[length] -= 1
        used = sorted(((x, bin_.count(x)) for x in set(bin_)), reverse=True)
        more = min(int(left[length]) // times for length, times in used)
        for length, times in used:
            left[length] -= more * times
        yield used, more + 1


def places(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: one row per (length, run of ranks)."""
    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for used, bins in patterns(counts, capacity):
        at = 0
        for length, times in used:
            rows.append((length, taken[length], times, sequence, at))
            taken[length] += times * bins
            at += times * length
        sequence += bins
    rows.sort()
    names = ("length", "rank", "times", "sequence", "offset")
    table = np.array(rows, dtype=np.int64).reshape(-1, len(names))
    return dict(zip(names, table.T))


def place(pieces: DataFrame, *, capacity: int = MAX_TOKENS, by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to pinned pieces with a ``length`` column.

    ``by`` orders pieces of equal length.
    """
    # At most ``capacity`` rows.
    histogram = pieces.groupBy("length").count().collect()
    table = places({row["length"]: row["count"] for row in histogram}, capacity)
    shift = 1 + max([0, *(row["count"] for row in histogram)])
    # Ranks are below shift, so one sorted key serves length and rank.
    keys = np.array([int(a) * shift + int(b) for a, b in zip(table["length"], table["rank"])], dtype=object)
    wide = len(keys) > 0 and keys[-1] >= 2**62
    keys = keys if wide else keys.astype(np.int64)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        kind = object if wide else np.int64
        key = length.to_numpy().astype(kind) * shift + rank.to_numpy()
        at = np.searchsorted(keys, key, side="right") - 1
        within = rank.to_numpy() - table["rank"][at]
        times = table["times"][at]
        return pd.DataFrame({
            "sequence_id": table["sequence"][at] + within // times,
            "offset": table["offset"][at] + within % times * length.to_numpy(),
        })

    ranked = running_total(
        pieces.withColumn(BUCKET, hash_bucket(buckets_of(pieces.sparkSession), *by)),
        ["length"], list(by), F.lit(1), "_rank",
    )
    placed = ranked.withColumn("_at", locate("length", "_rank"))
    return placed.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def crc(ids: Column) -> Column:
    return F.crc32(ids)


def pack_documents(
    docs: DataFrame, path: str | None = None, *, id: str = "doc_id", text: str = "text",
    keep: tuple[str, ...] = (), max_tokens: int = MAX_TOKENS, with_ids: bool = True,
) -> DataFrame:
    """Tokenise and pack: a row per piece with its place.

    Columns: id, *keep, piece, start, length, ids_crc32, ids (binary, left out
    without ``with_ids``), sequence_id, offset.
    """
    pieces = tokenize(docs, path or tokenizer_path(), id=id, text=text, keep=keep, max_tokens=max_tokens)
    pieces = pieces.withColumn("ids_crc32", crc(F.col("ids")))
    columns = [id, *keep, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return place(pinned(pieces.select(*columns)), capacity=max_tokens, by=(id, "piece", "ids_crc32"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed pieces' ids joined in place order.

    A sequence holds at most ``max_tokens`` ids, so a group is bounded.
    """
    joined = F.aggregate(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))),
        F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]),
    )
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
