"""Spelling variants of a corpus' words, by k-d trees over letter counts.

Words are near if one inserted, deleted or replaced letter makes one the other. One
edit moves a word's vector of letter counts by at most two: a replaced letter
takes one from one count and adds one to another, an inserted one adds one. So the
near words of a word lie in a small range around its vector, among the words of its
own length and of the next.

A k-d tree per length, fitted to a bounded sample of the words, deals the words out
into cells. Each word goes to its own cell as a point, and as a query to the cells
of its length and of the next whose box is in range. A task holds one tile of
points of a cell, builds a k-d tree of its own and searches it for its queries;
boxes out of range are skipped, the rest is compared by letter counts and then in
letter order. The sample decides only where a word is worked on, never what is
found. Cells are cut into tiles of a bounded number of letters, so equal vectors
(anagrams) cannot fill a task; a word has few near words, so pairs are few.

Counting is one pass with partial sums per task. A word's form is its most frequent
near word, if that is ``ratio`` times as frequent; forms are followed to the last by
doubling.

Defined cases: a null text has no words; a null id is an empty one; texts of any
length are read whole, in parts that end between words; repeated rows count twice;
of equally frequent near words the least in code-point order is the form; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import buckets_of, pinned

LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5

# The letters of a word, and where their counts stand in its vector.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
AXIS = np.zeros(256, dtype=np.int64)
AXIS[ord("a"):ord("z") + 1] = np.arange(26)
AXIS[0xC0:0x100] = np.arange(26, 90)
AXES = 90

PART = 1_000_000
HELD_WORDS = 200_000
SAMPLED_PER_CELL = 200
LEAF = 64
TILE_WORDS = 20_000
TILE_LETTERS = 4_000_000
QUERIES = 8192


def runs(text: str) -> Iterator[str]:
    """Maximal runs of letters, A-Z in lower case."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text) and (rest := RUN.match(text, end)):
            end = rest.end()
        # On bytes, lower() changes ASCII letters only.
        yield from RUN.findall(text[at:end].encode().lower().decode())
        at = end


def word_counts(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT, slip_every: int | None = None,
) -> DataFrame:
    """(word, n): words of at least ``least_length`` letters and ``least_count`` occurrences.

    With ``slip_every``, a word of a document loses a letter where the hash of id
    and word is divisible by it: known errors to measure by.
    """
    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"), F.col(text).alias("_t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for own, said in zip(batch.column("_id").to_pylist(), batch.column("_t").to_pylist()):
                    if not said:
                        continue
                    start = zlib.crc32(f"{own}:".encode())
                    for word, times in Counter(runs(said)).items():
                        if len(word) < least_length:
                            continue
                        if slip_every:
                            hashed = zlib.crc32(word.encode(), start)
                            if hashed % slip_every == 0:
                                place = hashed % len(word)
                                word = word[:place] + word[place + 1:]
                                if len(word) < least_length:
                                    continue
                        held[word] = held.get(word, 0) + times
                    if len(held) >= HELD_WORDS:
                        yield table()
                        held.clear()
        yield table()

    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-16-le"), dtype="<u2").reshape(len(words), -1)


def vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of words given as rows of code points."""
    at = np.repeat(np.arange(len(codes)) * AXES, codes.shape[1]) + AXIS[codes.ravel()]
    return np.bincount(at, minlength=len(codes) * AXES).reshape(len(codes), AXES).astype(np.int32)


class KdTree:
    """Boxes of letter counts, each split at the median of its most varied count."""

    def __init__(self, points: np.ndarray, most: int):
        self.axis, self.cut, self.below, self.above = [], [], [], []
        self.leaves: list[np.ndarray] = []
        self._build(points, np.arange(len(points)), most)

    def _build(self, points: np.ndarray, own: np.ndarray, most: int) -> int:
        """The number of the box; leaves are numbered -1, -2, ..."""
        if len(own) > most:
            part = points[own]
            axis = int(np.argmax(part.var(axis=0)))
            values = np.sort(part[:, axis])
            if values[0] < values[-1]:
                cut = int(values[(len(values) - 1) // 2])
                cut = cut if cut < values[-1] else int(values[np.searchsorted(values, cut) - 1])
                box = len(self.axis)
                for held, value in ((self.axis, axis), (self.cut, cut), (self.below, 0), (self.above, 0)):
                    held.append(value)
                left = part[:, axis] <= cut
                self.below[box] = self._build(points, own[left], most)
                self.above[box] = self._build(points, own[~left], most)
                return box
        self.leaves.append(own)
        return -len(self.leaves)

    def near(self, queries: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries whose range meets its box).

        In range are points that exceed a query's counts by at most ``up`` in all and
        fall short of them by at most ``down``. A box keeps how far a query is out of
        it each way; a split changes that in one count only.
        """
        if not len(queries):
            return
        none = np.zeros(len(queries), dtype=np.int32)
        # A box: number, queries in range, excess and shortfall, least and greatest counts so far.
        stack = [(0 if self.axis else -1, np.arange(len(queries)), none, none, {}, {})]
        while stack:
            box, own, over, under, least, most = stack.pop()
            if box < 0:
                yield -box - 1, own
                continue
            axis, cut = self.axis[box], self.cut[box]
            value = queries[own, axis]
            short = under + np.maximum(value - cut, 0)
            if axis in most:
                short = short - np.maximum(value - most[axis], 0)
            stay = short <= down
            if stay.any():
                stack.append((self.below[box], own[stay], over[stay], short[stay], least, {**most, axis: cut}))
            more = over + np.maximum(cut + 1 - value, 0)
            if axis in least:
                more = more - np.maximum(least[axis] - value, 0)
            stay = more <= up
            if stay.any():
                stack.append((self.above[box], own[stay], more[stay], under[stay], {**least, axis: cut + 1}, most))

    def home(self, queries: np.ndarray) -> np.ndarray:
        """The leaf whose box holds each vector."""
        found = np.zeros(len(queries), dtype=np.int64)
        for leaf, own in self.near(queries, 0, 0):
            found[own] = leaf
        return found


class Tile:
    """Points of one length, searched for near words."""

    def __init__(self, words: list[str]):
        self.words, self.codes = words, letters(words)
        counts = vectors(self.codes)
        self.tree = KdTree(counts, LEAF)
        # A count as so many ones: the product of two rows sums the lesser counts.
        highest = counts.max(axis=0)
        self.axis = np.repeat(np.arange(AXES), highest)
        self.level = np.concatenate([np.arange(1, h + 1) for h in highest])
        self.steps = self._steps(counts)

    def _steps(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.axis] >= self.level).astype(np.float32)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) one edit apart; queries are as long as the points or one letter shorter."""
        codes = letters(queries)
        longer = self.codes.shape[1] - codes.shape[1]
        counts = vectors(codes)
        steps = self._steps(counts)
        common = codes.shape[1] - (1 - longer)
        found = []
        for leaf, own in self.tree.near(counts, 1, 1 - longer):
            points = self.tree.leaves[leaf]
            q, p = np.nonzero(steps[own] @ self.steps[points].T >= common)
            if not len(q):
                continue
            q, p = own[q], points[p]
            # In letter order, a bounded number of letters at a time.
            strip = max(1, TILE_LETTERS // self.codes.shape[1])
            for at in range(0, len(q), strip):
                i, j = q[at:at + strip], p[at:at + strip]
                a, b = codes[i], self.codes[j]
                if longer:
                    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
                    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    one = front + back >= a.shape[1]
                else:
                    one = (a != b).sum(axis=1) == 1
                found.append((i[one], j[one]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def tile_words(length: int) -> int:
    """How many words of a length a task holds at once."""
    return max(1, min(TILE_WORDS, TILE_LETTERS // length))


def _cells(words: DataFrame) -> dict[int, KdTree]:
    """A tree per length that deals words out, from a sample of so many words per partition."""
    cells = buckets_of(words.sparkSession)
    count = words.count()
    share = min(1.0, SAMPLED_PER_CELL * cells / max(count, 1))
    by: dict[int, list[str]] = {}
    for row in words.select("word").sample(share, seed=12).toLocalIterator():
        by.setdefault(len(row["word"]), []).append(row["word"])
    return {length: KdTree(vectors(letters(sorted(own))), SAMPLED_PER_CELL) for length, own in by.items()}


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, n): both directions of each pair of near words, with the other's n.

    ``words`` is pinned and has distinct words of letters with their n.
    """
    trees = _cells(words)
    alone = KdTree(np.zeros((0, AXES), dtype=np.int32), 1)
    deal = "length int, leaf int, tile int, kind int, word string, n bigint"

    def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                own, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                sizes = np.array([len(w) for w in own])
                for length in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == length)
                    chosen = [own[k] for k in at]
                    yield length, chosen, n[at], vectors(letters(chosen))

    def sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for length, own, _, counts in by_length(batches):
            leaf, count = np.unique(trees.get(length, alone).home(counts), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(leaf), length, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(count.astype(np.int64))],
                names=["length", "leaf", "count"],
            )

    # Cells are as many as the sample allows, lengths beyond it aside: those above a tile are fewer still.
    full = words.mapInArrow(sizes_of, "length int, leaf int, count bigint").groupBy("length", "leaf").agg(F.sum("count").alias("count"))
    tiles = {
        (r["length"], r["leaf"]): -(-r["count"] // tile_words(r["length"]))
        for r in full.filter(F.col("count") > F.greatest(F.lit(1), F.least(F.lit(TILE_WORDS), F.floor(F.lit(TILE_LETTERS) / F.col("length"))))).collect()
    }

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(length: int, leaf: np.ndarray, tile: np.ndarray, kind: int, own: list[str], n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), length, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(tile.astype(np.int32)),
                    pa.array(np.full(len(at), kind, np.int32)), pa.array(own, pa.string()).take(pa.array(at)), pa.array(n[at]),
                ],
                names=["length", "leaf", "tile", "kind", "word", "n"],
            )

        for length, own, n, counts in by_length(batches):
            every = np.arange(len(own))
            home = trees.get(length, alone).home(counts)
            tile = np.array([
                zlib.crc32(word.encode()) % many if (many := tiles.get((length, leaf), 1)) > 1 else 0
                for word, leaf in zip(own, home.tolist())
            ])
            yield rows(length, home, tile, 0, own, n, every)
            for further in (0, 1):
                for leaf, at in trees.get(length + further, alone).near(counts, 1, 1 - further):
                    for k in range(tiles.get((length + further, leaf), 1)):
                        yield rows(length + further, np.full(len(at), leaf), np.full(len(at), k), 1 + further, own, n, at)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, points, point_n, tile = None, [], [], None
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                columns = [batch.column(name).to_numpy() for name in ("length", "leaf", "tile", "kind")]
                own, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                key = np.stack(columns, axis=1)
                ends = [*(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                at = 0
                for end in ends:
                    here, kind = tuple(key[at, :3].tolist()), int(key[at, 3])
                    if here != place:
                        place, points, point_n, tile = here, [], [], None
                    if kind == 0:
                        points += own[at:end]
                        point_n.append(n[at:end])
                    elif points:
                        if tile is None:
                            tile, point_n = Tile(points), [np.concatenate(point_n)]
                        q, p = tile.near(own[at:end])
                        if len(q):
                            asked, found = pa.array(own[at:end]).take(pa.array(q)), pa.array(points).take(pa.array(p))
                            yield pa.RecordBatch.from_arrays([asked, found, pa.array(point_n[0][p])], names=["word", "other", "n"])
                            if kind == 2:
                                yield pa.RecordBatch.from_arrays([found, asked, pa.array(n[at:end][q])], names=["word", "other", "n"])
                    at = end

    cells = ["length", "leaf", "tile"]
    return words.mapInArrow(dealt, deal).repartition(*cells).sortWithinPartitions(*cells, "kind").mapInArrow(
        search, "word string, other string, n bigint"
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: the end of the forms, by doubling."""
    ups = pinned(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = ups.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        further = pinned(ups.join(on, "root", "left").select(
            "word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")
        ))
        if further.filter("_moved").isEmpty():
            return ups
        ups = further.drop("_moved")


def group_variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) from distinct words with their n."""
    words = pinned(words.select("word", F.col("n").cast("bigint").alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("n"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("_near"), best.alias("_best"))
    much = -F.col("_best.n") >= ratio * F.col("n")
    forms = pinned(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(much, F.col("_best.other")).alias("form"), F.when(much, -F.col("_best.n")).alias("form_n"),
    ))
    return forms.join(roots(forms), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, *, ratio: int = RATIO, **counting) -> DataFrame:
    """The words of a corpus with their near words, forms and roots."""
    return group_variants(word_counts(docs, **counting), ratio=ratio)
