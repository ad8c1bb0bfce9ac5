"""Near-duplicate vectors within a label, by PCA-ordered tiled comparison.

Equal vectors are one class with a count. A rotation fitted on a bounded sample
(``sample_rows``) puts the directions of greatest energy first; it changes no
cosine. Classes of one label are ordered by the leading coordinate and cut into
tiles. Two tiles are compared unless their boxes in the leading coordinates are
too far apart for any pair. A comparison multiplies the leading coordinates of
all pairs, adds the product of the norms of the rest as a bound, goes on with the
pairs that can still reach the threshold, and computes the cosine of those left
in double precision from the vectors as given. A tile pair returns counts and a
spanning forest of its links, never the links.

The cost is that of comparing all rows of a label where no box excludes a tile
pair; rows, not pairs, move and are stored.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label, link with nothing; vectors of different
length link with nothing; repeated rows are rows of their own; a null id has no
place in the order and comes back with itself; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chatloom.llm.common import BUCKET, buckets_of, pinned, running_total, skewed_join
from chatloom.llm.graph import components, local_roots
from chatloom.operators.scan import slice_starts, starts_at_or_before

THRESHOLD = 0.93
TILE = 2048
BOX = 6
LEADING = 16
STRIP = 512
SAMPLE_TASKS = 8


def rotation(moments: np.ndarray) -> np.ndarray:
    """Columns: directions of falling energy, from the sum of unit vectors' outer products."""
    energy, directions = np.linalg.eigh(moments)
    return directions[:, np.argsort(energy)[::-1]]


def moments(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the outer products of unit vectors ``_v``, by width.

    They are summed in a few tasks; the driver gets one matrix per task and width.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            by_width: dict[int, list] = {}
            for v in batch.column("_v").to_pylist():
                by_width.setdefault(len(v), []).append(v)
            for width, own in by_width.items():
                unit = np.array(own, dtype=float)
                unit /= np.linalg.norm(unit, axis=1)[:, None]
                total[width] = total.get(width, 0) + unit.T @ unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))],
            names=["width", "products"],
        )

    found: dict[int, np.ndarray] = {}
    for row in vectors.coalesce(SAMPLE_TASKS).mapInArrow(summed, "width int, products array<double>").toLocalIterator():
        found[row["width"]] = found.get(row["width"], 0) + np.array(row["products"]).reshape(row["width"], row["width"])
    return found


def linked_pairs(x: np.ndarray, y: np.ndarray | None, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs with cosine >= threshold; within ``x`` (i < j) if y is None."""
    def prepared(rows):
        size = np.linalg.norm(rows, axis=1)
        turned = rows / size[:, None] @ turn
        rest = np.sqrt(np.maximum((turned**2)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))
        return size, turned, np.c_[rest, np.zeros(len(rows))]

    slack = 1e-9
    size_x, turn_x, rest_x = prepared(x)
    size_y, turn_y, rest_y = (size_x, turn_x, rest_x) if y is None else prepared(y)
    other = x if y is None else y
    width = x.shape[1]
    lead = min(LEADING, width)
    found = []
    for at in range(0, len(x), STRIP):
        head = turn_x[at:at + STRIP, :lead] @ turn_y[:, :lead].T
        i, j = np.nonzero(head + np.outer(rest_x[at:at + STRIP, lead], rest_y[:, lead]) >= threshold - slack)
        total, i, done = head[i, j], i + at, lead
        if y is None:
            keep = i < j
            i, j, total = i[keep], j[keep], total[keep]
        while done < width and len(i):
            more = min(2 * done, width)
            kept_i, kept_j, kept_total = [], [], []
            for s in range(0, len(i), 1 << 18):
                a, b = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
                t = total[s:s + (1 << 18)] + np.einsum("nd,nd->n", turn_x[a, done:more], turn_y[b, done:more])
                keep = t + rest_x[a, more] * rest_y[b, more] >= threshold - slack
                kept_i.append(a[keep])
                kept_j.append(b[keep])
                kept_total.append(t[keep])
            i, j, total, done = np.concatenate(kept_i), np.concatenate(kept_j), np.concatenate(kept_total), more
        exact = [np.zeros(0, bool)]
        for s in range(0, len(i), 1 << 18):
            a, b = i[s:s + (1 << 18)], j[s:s + (1 << 18)]
            exact.append(np.einsum("nd,nd->n", x[a], other[b]) / (size_x[a] * size_y[b]) >= threshold)
        keep = np.concatenate(exact)
        found.append((i[keep], j[keep]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *[f[0] for f in found]]), np.concatenate([none, *[f[1] for f in found]])


def near_duplicates(
    rows: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = THRESHOLD, sample_rows: int = 10_000,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    values = F.col(vector).cast("array<double>")
    whole = F.col(label).isNotNull() & (F.size(vector) > 0) & F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    ) & F.exists(values, lambda v: v != 0)
    given = rows.select(
        F.col(id).cast("bigint").alias("_id"), F.coalesce(whole, F.lit(False)).alias("_ok"),
        # Adding 0.0 makes a negative zero a zero.
        F.transform(values, lambda v: v + 0.0).alias("_v"), F.col(label).cast("string").alias("_label"),
    )
    usable = given.filter("_ok").withColumns({
        "_class": F.xxhash64("_label", "_v"), "_check": F.hash("_v", "_label"), "_dim": F.size("_v"),
    })
    key = ["_class", "_check", "_label", "_dim"]
    classes = pinned(usable.groupBy(*key).agg(
        F.count(F.lit(1)).alias("times"), F.min(F.coalesce("_id", F.lit(2**63 - 1))).alias("node"), F.first("_v").alias("_v"),
    ))
    # The rotation only orders the work: a bounded sample will do.
    found = classes.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    share = min(1.0, sample_rows / max(found, 1))
    drawn = classes.filter(F.pmod(F.xxhash64(F.lit("sample"), "_class"), F.lit(2**30)) < F.lit(int(share * 2**30) + 1))
    turns = {width: rotation(products) for width, products in moments(drawn.select("_v").limit(2 * sample_rows)).items()}
    turn_of = lambda width: turns[width] if width in turns else np.eye(width)

    @F.pandas_udf("array<double>")
    def leading(vectors: pd.Series) -> pd.Series:
        heads = []
        for v in vectors:
            unit = v / np.linalg.norm(v)
            head = unit @ turn_of(len(unit))[:, :BOX]
            heads.append(np.r_[head, np.zeros(BOX - len(head))])
        return pd.Series(heads)

    count = buckets_of(spark)
    headed = pinned(classes.withColumn("_head", leading("_v")))
    # Buckets hold like numbers of rows, also where vectors lie in a narrow cone or in one label.
    order = ["_label", "_dim", "_first"]
    headed = headed.withColumn("_first", F.get("_head", F.lit(0)))
    starts, found = slice_starts(headed, order, count)
    own = F.struct(*order).cast(headed.select(*order).schema.simpleString())
    headed = headed.withColumn(BUCKET, starts_at_or_before(starts, found, own))
    narrow = headed.select("_label", "_dim", "node", "_class", "_check", BUCKET, "_first")
    placed = running_total(narrow, ["_label", "_dim"], ["_first", "node", "_class", "_check"], F.lit(1), "_rank")
    tiled = pinned(headed.join(
        placed.select(*key, F.floor(F.col("_rank") / TILE).cast("int").alias("tile")), key
    ).drop(BUCKET, "_first"))
    bounds = [f(F.get("_head", F.lit(k))).alias(f"{n}{k}") for k in range(BOX) for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = pinned(tiled.groupBy("_label", "_dim", "tile").agg(*bounds))
    a, b = boxes.alias("a"), boxes.alias("b")
    apart = sum((
        F.pow(F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")), 2)
        for k in range(BOX)
    ), F.lit(0.0))
    # Unit vectors with cosine c are sqrt(2 - 2c) apart.
    met = a.join(b, ["_label", "_dim"]).filter(
        (F.col("a.tile") <= F.col("b.tile")) & (apart <= 2 - 2 * threshold + 1e-9)
    ).select("_label", "_dim", F.col("a.tile").alias("one"), F.col("b.tile").alias("two"))
    sides = met.select("_label", "_dim", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tile", "node", "_class", "_check"], kind="stable")
        first = (pdf["tile"] == pdf["one"]).to_numpy()
        vectors = np.stack(pdf["_v"].to_numpy()).astype(float)
        times, node = pdf["times"].to_numpy(), pdf["_class"].to_numpy()
        turn = turn_of(vectors.shape[1])
        if pdf["one"].iat[0] == pdf["two"].iat[0]:
            i, j = linked_pairs(vectors, None, turn, threshold)
        else:
            i, j = linked_pairs(vectors[first], vectors[~first], turn, threshold)
            i, j = np.flatnonzero(first)[i], np.flatnonzero(~first)[j]
        links = np.bincount(i, times[j], len(node)) + np.bincount(j, times[i], len(node))
        root = local_roots(len(node), i, j)
        some = links > 0
        return pd.DataFrame({"a": node[some], "b": node[root[some]], "links": links[some].astype(np.int64)})

    compared = tiled.select("_label", "_dim", "tile", "node", "_class", "_check", "times", "_v").join(
        sides, ["_label", "_dim", "tile"]
    ).groupBy("_label", "_dim", "one", "two").applyInPandas(compare, "a bigint, b bigint, links bigint")
    found_links = pinned(compared)
    groups = components(found_links.select("a", "b"))
    more = found_links.groupBy(F.col("a").alias("_class")).agg(F.sum("links").alias("_links"))
    known = classes.select("_class", "_check", "times", "node").join(more, "_class", "left").join(
        groups.withColumnRenamed("vertex", "_class"), "_class", "left"
    ).withColumn("least", F.coalesce("least", "_class"))
    named = pinned(known.select(
        "_class", "_check", "least", "node", "times", (F.col("times") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links")
    ))
    first = named.groupBy("least").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("_classes"))
    result = pinned(skewed_join(named, first, ["least"], "_classes", named.count()).select("_class", "_check", "times", "n_links", "component"))
    joined = skewed_join(
        usable.select("_id", "_class", "_check"), result, ["_class", "_check"], "times"
    ).select("_id", "n_links", "component")
    alone = given.filter("NOT _ok").select("_id", F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component"))
    return joined.unionByName(alone).select(
        F.col("_id").alias(id), "n_links", F.when(F.col("_id").isNotNull(), F.col("component")).alias("component_id"),
        F.coalesce(F.col("_id") == F.col("component"), F.lit(True)).alias("kept"),
    )
