from __future__ import annotations

import re
from collections import Counter

import numpy as np
from conftest import SF_DIR
from helpers import DOCUMENTS, ODD, odd_documents, plain
from pyspark.sql import functions as F

from chatloom.llm import embeddings, forest, graph
from chatloom.llm.queries import QUERIES


def union(count, pairs):
    parent = list(range(count))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(count)]


def brute_documents(rows, threshold=0.8):
    """(doc_id, class_id, n_links) by comparing every pair that shares a shingle."""
    sets = []
    for _, text in rows:
        words = re.findall(r"\w+", (text or "").lower())
        sets.append({tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    common = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1:])
    linked = [p for p, c in common.items() if c / (len(sets[p[0]]) + len(sets[p[1]]) - c) >= threshold]
    links = Counter(k for p in linked for k in p)
    root = union(len(rows), linked)
    return [(rows[k][0], rows[root[k]][0], links[k]) for k in range(len(rows))]


def test_every_link_between_documents_is_found(spark):
    for folder in (SF_DIR, "/root/testdata/sf0.01"):
        rows = sorted(map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()))
        got = QUERIES["op8_ngram_jaccard_join"](spark, folder).collect()
        assert plain(got) == plain(brute_documents(rows))


def near_copies(count):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(count):
        copy = list(words)
        for at in rng.integers(0, 120, k % 4):
            copy[at] = f"x{k}"
        rows.append((k, " ".join(copy)))
    return rows


def test_a_large_group_in_many_tiles(spark):
    rows = near_copies(150) + [(1000 + k, f"{k} " + " ".join(f"t{k}_{j}" for j in range(30))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = plain(brute_documents(rows))
    for tile in (500, 10_000_000):
        assert plain(forest.near_duplicate_join(docs, tile_shingles=tile).collect()) == want


def test_the_depth_reaches_the_recall():
    depth = forest.prefix_depth(0.8, 32, 0.99999)
    recall = lambda d: 1 - (1 - 0.8**d) ** 32
    assert recall(depth) >= 0.99999 > recall(depth + 1)
    assert forest.prefix_depth(0.8, 1, 1.0) == 1


def test_signatures_agree_as_often_as_sets_overlap():
    known = {}
    one = forest.shingles(" ".join(f"a{k}" for k in range(400)), known)
    two = forest.shingles(" ".join(f"a{k}" for k in range(100, 500)), known)
    a, b = forest.multipliers(2000)
    share = (forest.signature(one, a, b) == forest.signature(two, a, b)).mean()
    exact = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
    assert abs(share - exact) < 0.05


def test_odd_documents(spark):
    rows = plain(forest.near_duplicate_join(odd_documents(spark)).collect())
    assert len(rows) == 10
    by_id = {}
    for doc_id, class_id, links in rows:
        by_id.setdefault(doc_id, set()).add((class_id, links))
    assert by_id[5] == by_id[6] == {(5, 2)}
    assert by_id[1] == {(1, 0)} and by_id[None] == {(None, 0)}
    kept = forest.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 5, 7]
    assert kept.filter("_id = 'own _id'").count() == kept.count()
    empty = spark.createDataFrame([], DOCUMENTS)
    assert forest.near_duplicate_join(empty).collect() == [] and forest.drop_near_duplicates(empty).collect() == []


def test_one_row_of_each_class_stays(spark):
    base = [f"w{k}" for k in range(120)]
    near = [" ".join([*base, *[f"x{j}"] * j]) for j in range(4)]
    other = " ".join(f"u{k}" for k in range(60))
    rows = [(None, t) for t in near + near[:2]]  # a class of null ids
    rows += [(7, other), (7, other + " more"), (7, other), (8, other), (9, None), (9, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    kept = [tuple(r) for r in forest.drop_near_duplicates(docs).collect()]
    assert len([r for r in kept if r[0] is None]) == 1 and len([r for r in kept if r[0] == 7]) == 1
    assert plain(r for r in kept if r[0] in (8, 9)) == plain([(9, None), (9, ""), (9, "")])
    tied = spark.createDataFrame([(1, other, x) for x in "abc"], "doc_id BIGINT, text STRING, source STRING")
    assert forest.drop_near_duplicates(tied).collect() == forest.drop_near_duplicates(tied.orderBy(F.desc("source"))).collect()


def test_components_of_chains_and_hubs(spark):
    rng = np.random.default_rng(0)
    chain = [(k, k + 1) for k in range(100, 160)]
    hub = [(500, 501 + k) for k in range(200)] + [(7, 650)]
    some = [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (120, 2))]
    links = chain + hub + some + [(a, b) for b, a in chain[:5]] + [(3, 3)]
    names = sorted({x for p in links if p[0] != p[1] for x in p})
    place = {x: k for k, x in enumerate(names)}
    root = union(len(names), [(place[a], place[b]) for a, b in links if a != b])
    want = [(x, names[root[k]]) for k, x in enumerate(names)]
    got = graph.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()
    assert plain(got) == plain(want)
    one, other = (np.array([place[p[k]] for p in links if p[0] != p[1]]) for k in (0, 1))
    assert list(graph.local_roots(len(names), one, other)) == root


def brute_vectors(rows, threshold=0.93):
    usable = []
    for vec_id, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, dtype=float) if ok else None)
    linked = []
    for i in range(len(rows)):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    linked.append((i, j))
    links, root = Counter(k for p in linked for k in p), union(len(rows), linked)
    return [(r[0], links[k], rows[root[k]][0], root[k] == k) for k, r in enumerate(rows)]


def test_every_pair_of_vectors_is_compared(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 24))
    rows = [(k, [float(x) for x in np.float32(centres[k % 4] + rng.normal(size=24) * 0.25)], k % 2) for k in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [
        (300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 24, 0), (304, [nan] * 24, 0),
        (305, [inf] * 24, 0), (306, [None] * 24, 0), (307, rows[0][1], None), (308, rows[0][1][:10], 0), (309, [], 0),
        (310, [-0.0] * 23 + [1.0], 3), (311, [0.0] * 23 + [1.0], 3), (312, [2 * x for x in rows[0][1]], 0),
    ]
    table = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").withColumn("_v", F.lit("own"))
    want = plain(brute_vectors(rows))
    assert plain(embeddings.near_duplicates(table).collect()) == want
    monkeypatch.setattr(embeddings, "TILE", 32)
    assert plain(embeddings.near_duplicates(table, sample_rows=20).collect()) == want
    assert embeddings.near_duplicates(table.limit(0)).collect() == []


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 64)), 5, axis=0) + rng.normal(size=(200, 64)) * 0.3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.93, 1)))}
    for turn in (np.eye(64), embeddings.rotation(unit)):
        assert set(zip(*embeddings.linked_pairs(x, None, turn, 0.93))) == want
    i, j = embeddings.linked_pairs(x[:90], x[90:], np.eye(64), 0.93)
    assert set(zip(i, j + 90)) == {(a, b) for a, b in want if a < 90 <= b}
