"""Connected components of a set of links, by alternating stars.

Large stars join the greater neighbours of each vertex to its least neighbour,
small stars the lesser ones; after a number of rounds that grows with the
logarithm of the longest chain, all links of a component lead to its least
vertex. Before the first round each task contracts the links it holds to stars of
its own. The least neighbours and the links are pinned in the shared folder
between the steps, so that no plan holds more than one join, and a round is only
begun for links that are not stars yet. No component and no neighbourhood is
gathered: minima are partial aggregates, and a hub's links meet its minimum by
broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import pinned, skewed_join

LINKS_IN_FILE = 200_000
CONTRACTED_LINKS = 500_000


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each task as stars, a bounded number of links at a time."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1))
            vertices, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            root = local_roots(len(vertices), at[:len(a)], at[len(a):])
            leaf = np.flatnonzero(root != np.arange(len(vertices)))
            return pa.RecordBatch.from_arrays(
                [pa.array(vertices[root[leaf]]), pa.array(vertices[leaf])], names=["a", "b"]
            )

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CONTRACTED_LINKS:
                yield forest(held)
                held, count = [], 0
        if count:
            yield forest(held)

    return links.mapInArrow(stars, "a bigint, b bigint")


def _least_neighbours(pairs: DataFrame, by: str, other: str) -> DataFrame:
    """Per vertex its least neighbour, or itself if that is less, and how many links it has."""
    return pairs.groupBy(by).agg(F.least(F.min(other), F.col(by)).alias("least"), F.count(F.lit(1)).alias("_links"))


def components(links: DataFrame) -> DataFrame:
    """(vertex, least): the least vertex reachable from each vertex of a link.

    ``links`` has two bigint columns a and b; order and repeats do not matter.
    """
    several = links.filter("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    stars = pinned(_contracted(several).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        vertices = pinned(_least_neighbours(both, "a", "b"))
        # Links are stars when all vertices but the centres have one link.
        ends, open_ = vertices.agg(F.sum("_links"), F.count_if(F.expr("_links > 1 AND least < a"))).first()
        if not open_:
            return vertices.select(F.col("a").alias("vertex"), "least")
        # Links are narrow and grow few: they need no more files than their number asks for.
        files = max(8, ends // (2 * LINKS_IN_FILE))
        large = pinned(
            skewed_join(both, vertices, ["a"], "_links", ends).filter("b > a")
            .select(F.col("least").alias("a"), "b").distinct().coalesce(files)
        )
        nearest = pinned(_least_neighbours(large, "b", "a").coalesce(files))
        near = skewed_join(large, nearest, ["b"], "_links", ends // 2)
        # Of a link (a, b) with b's least neighbour: (least, b), and (least, a) where a is another.
        stars = pinned(near.select(F.explode(F.array(
            F.struct(F.col("least").alias("a"), F.col("b").alias("b")),
            F.struct(F.col("least").alias("a"), F.col("a").alias("b")),
        )).alias("_l")).select("_l.*").filter("a <> b").distinct().coalesce(files))


def local_roots(count: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least vertex reachable from each of ``count`` vertices, for links in memory."""
    root = np.arange(count)
    while len(one):
        low = np.minimum(root[one], root[other])
        new = root.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, other, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
