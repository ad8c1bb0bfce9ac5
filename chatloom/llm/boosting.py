"""Gradient-boosted trees on dense features, and calibration.

Fitting takes a numpy matrix whose number of rows the caller bounds, or a DataFrame
of any number of rows: Spark then sums the derivatives per node, feature and bin, and
only these sums reach the driver. Fitted trees score arrays inside tasks
(``Trees.margin``) or become a Spark expression (``Trees.column``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from chatloom.llm.common import pinned

# Derivatives are summed as whole numbers of this part of one, so that no order of
# adding them changes a tree; 2**33 rows fit.
FINE = 2**28
PIN_EVERY = 5  # rounds after which a plan is cut; rows are cached between

def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth: node k has the children 2k+1 (at most the threshold) and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    held: tuple[Trees, ...] = ()  # of each fold, the trees fitted without it

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return total

    def column(self, features: list[Column]) -> Column:
        inner = self.feature.shape[1]

        def branch(tree: int, node: int) -> Column:
            if node >= inner:
                return F.lit(float(self.leaf[tree, node - inner]))
            test = features[self.feature[tree, node]] <= F.lit(float(self.threshold[tree, node]))
            if not np.isfinite(self.threshold[tree, node]):  # an unsplit node goes left
                return branch(tree, 2 * node + 1)
            return F.when(test, branch(tree, 2 * node + 1)).otherwise(branch(tree, 2 * node + 2))

        trees = [branch(t, 0) for t in range(len(self.leaf))]
        return reduce(lambda a, b: a + b, trees, F.lit(self.base))


def fit(
    x: np.ndarray | DataFrame, y: np.ndarray | None = None, *, rounds: int = 60, depth: int = 3, rate: float = 0.2,
    bins: int = 48, least: float = 2.0, ridge: float = 1.0, folds: int = 0,
) -> Trees:
    """Second-order boosting of the logistic loss on histograms of quantile bins.

    A leaf needs ``least`` of second derivatives. Without two classes all scores
    are the class's share. A DataFrame ``x`` has the columns of ``counted``, and its
    trees are also fitted without each of its ``folds`` parts.
    """
    if isinstance(x, DataFrame):
        return _fit_counted(x, rounds, depth, rate, bins, least, ridge, folds)
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    kept = []
    if len(np.unique(y)) == 2:
        edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
        # A skewed feature's quantiles may all be its smallest value.
        edges = [np.unique(np.r_[e, np.linspace(c.min(), c.max(), 9)[:-1]]) for e, c in zip(edges, x.T)]
        binned = [np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)]
        margin = np.full(len(y), base)
        for _ in range(rounds):
            p = sigmoid(margin)
            gradient, curve = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), dtype=np.int64)
            for k in range(inner):
                rows = np.flatnonzero(node == k)
                best, cut = 1e-3, None
                if len(rows):
                    g_all, h_all = gradient[rows].sum(), curve[rows].sum()
                    for j, e in enumerate(edges):
                        where = binned[j][rows]
                        g = np.bincount(where, gradient[rows], len(e) + 1).cumsum()[:-1]
                        h = np.bincount(where, curve[rows], len(e) + 1).cumsum()[:-1]
                        gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                        gain[(h < least) | (h_all - h < least)] = 0
                        if len(gain) and gain.max() > best:
                            best, cut = float(gain.max()), (j, int(gain.argmax()))
                if cut:
                    feature[k], threshold[k] = cut[0], edges[cut[0]][cut[1]]
                node[rows] = 2 * k + 1 + (x[rows, feature[k]] > threshold[k])
            at = node - inner
            leaf = -rate * np.bincount(at, gradient, leaves) / (np.bincount(at, curve, leaves) + ridge)
            margin += leaf[at]
            kept.append((feature, threshold, leaf))
    stack = lambda i, width, kind: np.array([t[i] for t in kept], dtype=kind).reshape(-1, width)
    return Trees(base, stack(0, inner, np.int64), stack(1, inner, float), stack(2, leaves, float))


def counted(rows: DataFrame) -> DataFrame:
    """(f, part, n, s): of rows (f, part, y), how many are alike and the sum of their labels."""
    return rows.groupBy("f", "part").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("s"))


def _edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature the edges of quantile bins. They are worked out on the counts of its
    values in three significant digits, which are few however many rows there are."""
    value = F.format_string("%.2e", F.col("v")).cast("double")
    found = rows.select("n", F.posexplode("f").alias("j", "v")).groupBy("j", value.alias("v")).agg(F.sum("n").alias("n")).collect()
    edges = []
    for j in range(1 + max((r["j"] for r in found), default=-1)):
        own = sorted((r["v"], r["n"]) for r in found if r["j"] == j)
        v, upto = np.array([a for a, _ in own]), np.cumsum([b for _, b in own])
        at = np.linspace(0, 1, bins + 1)[1:-1] * (upto[-1] - 1)
        low, high = (v[np.searchsorted(upto, k, side="right")] for k in (np.floor(at), np.ceil(at)))
        e = np.unique(low + (high - low) * (at - np.floor(at)))
        edges.append(np.unique(np.r_[e, np.linspace(v[0], v[-1], 9)[:-1]]))
    return edges


def _fit_counted(rows: DataFrame, rounds, depth, rate, bins, least, ridge, folds) -> Trees:
    """All rows as numbers of bins, alike ones as one row. A round takes one sum per
    level, for the trees of all rows and those without each fold at once. Rows keep
    their margins and derivatives from round to round."""
    models, inner = folds + 1, 2**depth - 1
    total, labels = np.zeros(models), np.zeros(models)
    for r in rows.groupBy("part").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        into = [m for m in range(models) if m == folds or r["part"] != m]
        total[into] += r["n"]
        labels[into] += r["s"]
    share = (labels + 0.5) / (total + 1.0)
    base = np.log(share / (1 - share))
    grown = [m for m in range(models) if 0 < labels[m] < total[m]]
    kept: list[list] = [[] for _ in range(models)]

    def derived(df, margins):
        scored = df.selectExpr("b", "part", "n", "s", "root", *margins)
        scored = scored.selectExpr("*", *[f"1 / (1 + exp(-m{m})) AS p{m}" for m in grown])
        return scored.selectExpr(
            "b", "part", "n", "s", "root", *[f"m{m}" for m in grown],
            *[f"CAST(round((p{m} * n - s) * {FINE}) AS BIGINT) AS g{m}" for m in grown],
            *[f"CAST(round(greatest(p{m} * (1 - p{m}), 1e-6D) * n * {FINE}) AS BIGINT) AS h{m}" for m in grown],
        )

    def walked(df, levels):
        """Each row's node after so many levels. Trees are array literals and the root's
        number is a column, so that the generated code is the same in every round."""
        df = df.selectExpr("*", *[f"root AS n{m}" for m in grown])
        array = lambda values: f"array({', '.join(map(str, values))})"
        for _ in range(levels):
            right = {m: f"b[{array(feature[m])}[n{m}]] > {array(cut[m])}[n{m}]" for m in grown}
            df = df.selectExpr(*df.columns[:-len(grown)], *[f"2 * n{m} + 1 + CASE WHEN {right[m]} THEN 1 ELSE 0 END AS n{m}" for m in grown])
        return df

    if grown:
        edges = _edges(rows, bins)
        width = 1 + max(map(len, edges))
        # Where a feature has an edge; the other places are no splits.
        real = np.arange(width)[None] < np.array([len(e) for e in edges])[:, None]
        all_edges = F.array(*[F.array(*[F.lit(float(v)) for v in e]) for e in edges])
        bin_of = lambda v, j: F.size(F.filter(F.get(all_edges, j), lambda e: e < v))
        binned = rows.select(F.transform("f", bin_of).alias("b"), "part", "n", "s").groupBy("b", "part").agg(
            F.sum("n").alias("n"), F.sum("s").alias("s")
        )
        binned = pinned(binned.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).withColumn("root", F.lit(0)))
        state, before = derived(binned, [f"{float(base[m])!r}D AS m{m}" for m in grown]).persist(), None
    for step in range(1, rounds + 1 if grown else 1):
        feature = {m: np.zeros(inner, np.int64) for m in grown}
        cut = {m: np.full(inner, width) for m in grown}  # an unsplit node goes left
        sums = {m: np.zeros((2 * inner + 1, 2)) for m in grown}
        for level in range(depth):
            first, until = 2**level - 1, 2**(level + 1) - 1
            each = ", ".join(f"struct({m} AS m, n{m} AS node, g{m} AS g, h{m} AS h)" for m in grown)
            parts = walked(state, level).selectExpr("b", "part", f"inline(array({each}))").filter(f"m = {folds} OR part <> m")
            found = parts.select("m", "node", "g", "h", F.posexplode("b").alias("j", "bin")).groupBy("m", "node", "j", "bin").agg(
                F.sum("g").alias("g"), F.sum("h").alias("h")
            ).collect()
            if before is not None:
                before = before.unpersist() and None
            m_at, node_at, j_at, bin_at, g_at, h_at = zip(*found)
            table = np.zeros((models, until - first, len(edges), width, 2))
            table[m_at, np.array(node_at) - first, j_at, bin_at] = np.array([g_at, h_at], dtype=float).T / FINE
            for m in grown:
                for node in range(first, until):
                    own = table[m, node - first]
                    g_all, h_all = own[0].sum(axis=0)
                    g, h = np.moveaxis(own.cumsum(axis=1), 2, 0)
                    gain = g**2 / (h + ridge) + (g_all - g)**2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
                    gain[~real | (h < least) | (h_all - h < least)] = 0
                    left = (g_all, h_all)
                    if gain.max() > 1e-3:
                        j, k = np.unravel_index(gain.argmax(), gain.shape)
                        feature[m][node], cut[m][node], left = j, k, (g[j, k], h[j, k])
                    sums[m][2 * node + 1], sums[m][2 * node + 2] = left, (g_all - left[0], h_all - left[1])
        leaf = {m: -rate * sums[m][inner:, 0] / (sums[m][inner:, 1] + ridge) for m in grown}
        for m in grown:
            threshold = np.array([edges[j][k] if k < width else np.inf for j, k in zip(feature[m], cut[m])])
            kept[m].append((feature[m], threshold, leaf[m]))
        value = {m: f"array({', '.join(f'{float(v)!r}D' for v in leaf[m])})[n{m} - {inner}]" for m in grown}
        before, state = state, derived(walked(state, depth), [f"m{m} + {value[m]} AS m{m}" for m in grown])
        state = state.persist() if step % PIN_EVERY else pinned(state)
    if grown:
        before.unpersist() if before is not None else None
        state.unpersist()
    stack = lambda m, i, width, kind: np.array([t[i] for t in kept[m]], dtype=kind).reshape(-1, width)
    trees = [Trees(float(base[m]), stack(m, 0, inner, np.int64), stack(m, 1, inner, float), stack(m, 2, inner + 1, float)) for m in range(models)]
    return Trees(trees[-1].base, trees[-1].feature, trees[-1].threshold, trees[-1].leaf, tuple(trees[:-1]))


@dataclass(frozen=True)
class Isotonic:
    """Non-decreasing map from margins to probabilities: knots joined by lines."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        # A small share of the sigmoid keeps the order within a flat stretch.
        return 0.99 * np.interp(margin, self.at, self.value) + 0.01 * sigmoid(margin)


def isotonic(margin: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Isotonic:
    """Pool adjacent violators; each pool is one knot at its mean margin. With ``n``,
    an entry stands for so many rows and ``y`` is the sum of their labels."""
    if not len(y):
        return Isotonic(np.array([0.0]), np.array([0.5]))
    pools: list[list[float]] = []  # rows, sum of labels, sum of margins
    for k in np.argsort(margin, kind="stable"):
        rows = 1.0 if n is None else float(n[k])
        pools.append([rows, float(y[k]), rows * float(margin[k])])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return Isotonic(np.array([m / c for c, _, m in pools]), np.array([s / c for c, s, _ in pools]))
