"""Near-duplicate documents by MinHash bands with exact verification.

A document is its set of five-word shingles; equal sets are one class. Each class
gets a signature of ``trees`` prefixes, all of one depth: the longest at which a
pair at the threshold shares a prefix in some tree with at least the target recall,
worked out from the parameters. This takes the place of an LSH forest, whose depth
follows the data: the longest prefix that has the recall for every pair is known
beforehand, and a group of any size under one prefix is cut into tiles anyway.
Documents of one prefix, found by the hash of its values, are candidates of each
other; they are joined to the prefix's least member, and connected candidates form
a cluster. All pairs of a cluster are then compared exactly, tile by tile, on the
whole sets.

A tile pair returns counts and a spanning forest of its links, never the links,
so a group of thousands of copies costs comparisons but no rows. Tiles hold a
bounded number of shingles; prefixes, clusters and classes with a large share of
all rows, of which there can only be few, are joined by broadcast.

Defined cases: a text of one to four words has one shingle, all its words; null,
empty and wordless texts link with nothing and are their own class; rows of one
id and text share a class; null ids come after all others; an empty table gives
no rows. ``drop_near_duplicates`` keeps one row of each class of worded texts, that
of the least (id, hash of the text) and among its repeats the one whose hash as
JSON is least; rows without words all stay, and so do further columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import BUCKET, buckets_of, hash_bucket, pinned, running_total, skewed_join
from chatloom.llm.graph import components, local_roots

THRESHOLD = 0.8
SHINGLE = 5
TREES = 32
MOST_DEPTH = 8
TARGET_RECALL = 0.99999
TILE_SHINGLES = 200_000
# What a document adds to its tile beside its shingles, so that a tile's table of
# pairs stays small where documents are short.
TILE_DOCUMENT = 200
STRIP = 256
NO_ID = 2**63 - 1

WORD = re.compile(r"\w+")


def prefix_depth(threshold: float, trees: int, recall: float, most_depth: int = MOST_DEPTH) -> int:
    """The longest prefix at which a pair at the threshold is found with the recall."""
    depth = most_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str, known: dict[str, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    import xxhash

    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    for word in set(words).difference(known):
        known[word] = xxhash.xxh3_64_intdigest(word)
    hashed = np.array([known[w] for w in words], dtype=np.uint64)
    if len(known) > 200_000:
        known.clear()
    count = max(1, len(words) - size + 1)
    mixed = np.full(count, len(words) if len(words) < size else size, dtype=np.uint64)
    for k in range(min(size, len(words))):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashed[k:k + count]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    draw = lambda: rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(), draw()


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each hash function over the shingles, 32 bits each."""
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 2048):
        part = found[None, at:at + 2048] * a[:, None] + b[:, None]
        least = np.minimum(least, part.min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def _signed(docs: DataFrame, id: str, text: str, depth: int, trees: int) -> DataFrame:
    """(_id, _text, node, n, prefixes) of every document; node null without words."""
    rows = docs.select(
        F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"),
        F.col(text).alias("_t"),
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        a, b = multipliers(trees * depth)
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                node, size, prefixes = [], [], []
                for value in batch.column("_t").to_pylist():
                    found = shingles(value or "", known)
                    size.append(len(found))
                    if not len(found):
                        node.append(None)
                        prefixes.append([])
                        continue
                    digest = xxhash.xxh3_64_intdigest(found.tobytes())
                    node.append(digest - 2**64 if digest >= 2**63 else digest)
                    values = signature(found, a, b).reshape(trees, depth).astype(np.uint64)
                    mixed = np.arange(1, trees + 1, dtype=np.uint64)
                    for k in range(depth):
                        mixed = (mixed + values[:, k]) * np.uint64(0x9E3779B97F4A7C15)
                        mixed ^= mixed >> np.uint64(31)
                    prefixes.append(mixed.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id"), batch.column("_text"), pa.array(node, pa.int64()),
                        pa.array(size, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    names=["_id", "_text", "node", "n", "prefixes"],
                )

    return rows.mapInArrow(sign, "_id bigint, _text bigint, node bigint, n bigint, prefixes array<bigint>")


def similar_pairs(sets: list[np.ndarray], first: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) with Jaccard >= threshold; with ``first``, across the two sides only."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(count), sizes)
    # A shingle of one document is in no intersection.
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((count, count), dtype=np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((count, min(4096, width - at)), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        used = np.flatnonzero(block.any(axis=1))
        part = block[used]
        common[np.ix_(used, used)] += part @ part.T
    found = []
    for at in range(0, count, STRIP):
        part = common[at:at + STRIP].astype(np.float64)
        both = sizes[at:at + STRIP, None] + sizes[None, :]
        near = part / np.maximum(both - part, 1) >= threshold
        if first is not None:
            near &= first[at:at + STRIP, None] != first[None, :]
        i, j = np.nonzero(np.triu(near, at + 1))
        found.append((i + at, j))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def near_duplicate_classes(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
    trees: int = TREES, recall: float = TARGET_RECALL, tile_shingles: int = TILE_SHINGLES,
) -> DataFrame:
    """(_id, _text, class_id, n_links, keeper) for every row.

    keeper is the class's least (_id, _text), null without words; class_id is the smallest id among the documents reachable by links; n_links
    counts the other documents linked directly, copies included. _id is the id,
    or the largest number for a null one; _text is the text's hash.
    """
    signed = pinned(_signed(docs, id, text, prefix_depth(threshold, trees, recall), trees))
    classes = pinned(signed.filter("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("_id", "_text")).alias("_at"),
        F.first("n").alias("n"), F.first("prefixes").alias("prefixes"),
    ))
    placed = classes.select("node", F.explode("prefixes").alias("prefix"))
    nodes = placed.groupBy("prefix").agg(F.count(F.lit(1)).alias("_members"), F.min("node").alias("pivot"))
    met = skewed_join(placed, pinned(nodes.filter("_members > 1")), ["prefix"], "_members")
    clusters = components(met.select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    members = pinned(
        classes.drop("prefixes").join(clusters.select(F.col("vertex").alias("node"), F.col("least").alias("cluster")), "node")
        .withColumn(BUCKET, hash_bucket(buckets_of(docs.sparkSession), "node"))
    )
    tiled = running_total(members, ["cluster"], ["node"], F.col("n") + TILE_DOCUMENT, "_before").withColumn(
        "tile", F.floor(F.col("_before") / tile_shingles).cast("int")
    ).select("cluster", "node", "times", "_at", "tile")
    tiled = pinned(tiled)
    last = tiled.groupBy("cluster").agg(F.max("tile").alias("last"), F.count(F.lit(1)).alias("_members"))
    meetings = skewed_join(tiled, last, ["cluster"], "_members", tiled.count()).select(
        F.col("_at._id").alias("_id"), F.col("_at._text").alias("_text"), "cluster", "node", "times", "tile", "last",
    )
    texts = docs.select(
        F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_text"), F.col(text).alias("_t")
    ).join(meetings, ["_id", "_text"]).dropDuplicates(["_id", "_text"])  # of a row repeated under one id, one

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [shingles(x, known).tobytes() for x in batch.column("_t").to_pylist()]
                kept = batch.select(["cluster", "node", "times", "tile", "last"])
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(found, pa.binary())], names=[*kept.schema.names, "found"]
                )

    sets = texts.select("cluster", "node", "times", "tile", "last", "_t").mapInArrow(
        to_sets, "cluster bigint, node bigint, times bigint, tile int, last int, found binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
    paired = sets.select("cluster", "node", "times", "tile", other, "found").select(
        "cluster", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"),
        "node", "times", "tile", "found",
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node", kind="stable")
        node, times = pdf["node"].to_numpy(), pdf["times"].to_numpy()
        whole = pdf["one"].iat[0] == pdf["two"].iat[0]
        first = None if whole else (pdf["tile"] == pdf["one"]).to_numpy()
        i, j = similar_pairs([np.frombuffer(x, dtype=np.uint64) for x in pdf["found"]], first, threshold)
        links = np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))
        some = links > 0
        root = local_roots(len(node), i, j)
        return pd.DataFrame({"a": node[some], "b": node[root[some]], "links": links[some].astype(np.int64)})

    found_links = pinned(paired.groupBy("cluster", "one", "two").applyInPandas(compare, "a bigint, b bigint, links bigint"))
    groups = components(found_links.select("a", "b"))
    more = found_links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("_links"))
    known = classes.select("node", "times", F.col("_at").alias("_first")).join(more, "node", "left").join(
        groups.withColumnRenamed("vertex", "node"), "node", "left"
    )
    named = pinned(known.select(
        "node", F.coalesce("least", "node").alias("least"), "_first",
        "times", (F.col("times") - 1 + F.coalesce("_links", F.lit(0))).cast("bigint").alias("n_links"),
    ))
    ids = named.groupBy("least").agg(F.min("_first").alias("keeper"), F.count(F.lit(1)).alias("_classes"))
    result = pinned(skewed_join(named, ids, ["least"], "_classes", named.count()).select("node", "times", "n_links", "keeper"))
    linked = skewed_join(
        signed.filter("node IS NOT NULL").select("_id", "_text", "node"), result, ["node"], "times"
    ).select("_id", "_text", F.col("keeper._id").alias("class_id"), "n_links", "keeper")
    alone = signed.filter("node IS NULL").select("_id", "_text", F.col("_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("struct<_id:bigint,_text:bigint>").alias("keeper"))
    return linked.unionByName(alone)


def near_duplicate_join(docs: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """(id, class_id, n_links) for every document."""
    found = near_duplicate_classes(docs, id=id, **options)
    given = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return found.select(given("_id").alias(id), given("class_id").alias("class_id"), "n_links")


def drop_near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, that of the smallest id. All columns stay."""
    found = near_duplicate_classes(docs, id=id, text=text, **options)
    kept = pinned(found.filter("keeper IS NULL OR (_id = keeper._id AND _text = keeper._text)").groupBy("_id", "_text").agg(
        ((F.count(F.lit(1)) > 1) & F.bool_and(F.col("keeper").isNotNull())).alias("repeated")
    ))
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(id).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_text"),
    )
    single = rows.join(kept.filter("NOT repeated"), ["_id", "_text"], "left_semi").select("_row")
    repeated = kept.filter("repeated")
    if not repeated.isEmpty():
        # Partial aggregates: a row repeated often meets in no one task.
        one = rows.join(repeated, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(
            F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")
        )
        single = single.unionByName(one.select("_row"))
    return single.select("_row.*")
