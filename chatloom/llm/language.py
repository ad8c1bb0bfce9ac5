"""Language identification by compression.

For each language a zstandard dictionary holds raw text of that language, letters
only and in lower case. A text, reduced in the same way, is compressed in blocks with each dictionary in turn; the dictionary that makes
it smallest names the language. Every block starts from the dictionary again, so
a long text cannot drown it in its own repeats. Narrow margins are rejected.

Learning takes a bounded sample: ``dictionary_bytes`` per language, from rows
whose crc32 of the id as text is no multiple of 5, at most ``slice_chars``
characters of each from a place its hash names. So a language fills its dictionary
from many texts whatever their lengths, and the driver gets bounded bytes; texts are
always classified whole.

Defined cases: a null text, or one without letters, is `und` with score 0; rows
without a language teach nothing; with a single learned language its score is 1;
with none every row is `und`; an empty table gives no rows; repeated rows and
further columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BYTES = 2048
LEVEL = 6
UNKNOWN = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-cased words: capitals, marks and digits say little about the language."""
    return NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "replace")


def held_out(id: Column) -> Column:
    return F.crc32(id.cast("string")) % 5 == 0


def learn(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang", dictionary_bytes: int = 98_304,
    slice_chars: int = 4096,
) -> dict[str, bytes]:
    """A dictionary per language, from slices of documents in hash order.

    Two passes: the first sums the slices' sizes per language, which tells what share
    of its rows fills a dictionary four times over; the second gathers that share.
    """
    known = docs.select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.coalesce(F.col(id).cast("string"), F.lit("-")).alias("_id"),
    ).filter(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0) & (F.crc32("_id") % 5 != 0))
    spare = F.greatest(F.length("text") - slice_chars + 1, F.lit(1))
    start = F.pmod(F.xxhash64(F.lit("slice"), "_id"), spare).cast("int") + 1
    known = known.select("lang", "_id", F.substring("text", start, F.lit(slice_chars)).alias("text"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(2**30)) / F.lit(float(2**30))
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    share = {row["lang"]: min(1.0, 4.0 * dictionary_bytes / row["bytes"]) for row in sizes}
    wanted = [F.struct(F.lit(k).alias("lang"), F.lit(v).alias("share")) for k, v in share.items()]
    if not wanted:
        return {}
    table = docs.sparkSession.range(1).select(F.explode(F.array(*wanted)).alias("w")).select("w.*")
    sample = known.withColumn("_at", place).join(F.broadcast(table), "lang").filter(F.col("_at") < F.col("share"))
    rows = sample.select("lang", "_at", "text").collect()
    content: dict[str, list[bytes]] = {k: [] for k in share}
    room = dict.fromkeys(share, dictionary_bytes)
    for row in sorted(rows, key=lambda r: (r["lang"], r["_at"], r["text"])):
        data = letters(row["text"])[:room[row["lang"]]]
        content[row["lang"]].append(data)
        room[row["lang"]] -= len(data)
    # The most frequent language first: it gets the texts too short to tell.
    common = sorted(sizes, key=lambda r: (-r["bytes"], r["lang"]))
    return {r["lang"]: b"\n".join(content[r["lang"]]) for r in common}


def classify(
    docs: DataFrame, dictionaries: dict[str, bytes], *, id: str = "doc_id", text: str = "text",
    least_margin: float = 0.01,
) -> DataFrame:
    """(id, best, score, language): the closest language, how clearly, and the
    same language unless the margin is narrow (then `und`).

    The margin is the share by which the smallest encoding is below the next.
    """
    names = list(dictionaries)

    @F.pandas_udf("best string, score double, margin double")
    def closest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as zstd

        encoders = []
        for content in dictionaries.values():
            shared = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            encoders.append(zstd.ZstdCompressor(
                dict_data=shared, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress)
        for texts in batches:
            best, score, margins = [], [], []
            for value in texts:
                if not names or not value or not any(map(str.isalpha, value)):
                    best.append(UNKNOWN)
                    score.append(0.0)
                    margins.append(0.0)
                    continue
                data = letters(value)
                blocks = [data[at:at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
                sizes = np.array([sum(len(encode(b)) for b in blocks) for encode in encoders], dtype=float)
                order = np.argsort(sizes, kind="stable")
                if len(order) == 1:
                    margin, certain = 1.0, 1.0
                else:
                    gap = sizes[order[1]] - sizes[order[0]]
                    margin = gap / sizes[order[1]]
                    certain = 1.0 - 0.5 ** (1.0 + gap / 4.0)
                best.append(names[order[0]])
                score.append(float(certain))
                margins.append(float(margin))
            yield pd.DataFrame({"best": best, "score": score, "margin": margins})

    found = docs.select(F.col(id), closest(F.col(text)).alias("_f"))
    clear = F.when(F.col("_f.margin") >= least_margin, F.col("_f.best")).otherwise(F.lit(UNKNOWN))
    return found.select(id, "_f.best", "_f.score", clear.alias("language"))
