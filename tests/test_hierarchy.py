"""Merge trees, condensed trees and projection indexes against walks over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import clustering as K
from statloom.operators import hierarchy as H
from statloom.operators.projections import ProjectionIndex


def walked(edges):
    """Merges ``(w, e, a, b, left node, right node, size)`` in order; nodes are rows or ('m', number)."""
    up, size, out = {}, {}, []

    def root(v):
        while v in up:
            v = up[v]
        return v

    for w, a, b in sorted(edges):
        x, y = root(a), root(b)
        if x != y:
            node = ("m", len(out))
            up[x] = up[y] = node
            size[node] = size.get(x, 1) + size.get(y, 1)
            out.append((w, a, b, x, y, size[node]))
    return out


def brute_condensed(edges, smallest):
    """Rows to the name (least row) of their chosen cluster, None for noise, and all stabilities, from the tops down."""
    merges = walked(edges)
    size = lambda n: merges[n[1]][5] if isinstance(n, tuple) else 1
    rows_of = lambda n: rows_of(merges[n[1]][3]) + rows_of(merges[n[1]][4]) if isinstance(n, tuple) else [n]
    tops = set(range(len(merges))) - {n[1] for m in merges for n in m[3:5] if isinstance(n, tuple)}
    stabilities, label = [], {}

    def grow(node, birth, top):
        own, kids, x = 0.0, [], node
        while True:
            w, _, _, left, right, n = merges[x[1]]
            lam = 1 / max(w, 1e-12)
            big = [c for c in (left, right) if size(c) >= smallest]
            if len(big) == 2:
                own += n * (lam - birth)
                kids = [grow(c, lam, False) for c in big]
                break
            own += (n - sum(map(size, big))) * (lam - birth)
            if not big:
                break
            x = big[0]
        stabilities.append(own)
        under = sum(best for best, _ in kids)
        if kids and (under > own or top):
            return under, [c for _, picked in kids for c in picked]
        return own, [node]

    for t in tops:
        if merges[t][5] >= smallest:
            for node in grow(("m", t), 0.0, True)[1]:
                members = rows_of(node)
                for r in members:
                    label[r] = min(members)
    return label, sorted(stabilities)


def graph(kind, n=300, seed=1):
    rng = random.Random(seed)
    if kind == "path":
        return [(rng.random(), i, i + 1) for i in range(n - 1)]
    if kind == "rising":
        return [(float(i), i, i + 1) for i in range(n - 1)]
    if kind == "star":
        return [(rng.random(), 0, i) for i in range(1, n)]
    if kind == "ties":
        return [(rng.choice([1.0, 2.0, 3.0]), rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)]
    if kind == "parts":
        return [(rng.random(), i, j) for i in range(n) for j in [rng.randrange(n // 3) * 3 + i % 3 for _ in range(3)] if i != j]
    points = [(rng.gauss(4 * (i % 5), 0.5), rng.gauss(3 * (i % 3), 0.5)) for i in range(n)]
    out = []
    for i, p in enumerate(points):
        near = sorted((math.dist(p, q), j) for j, q in enumerate(points) if j != i)[:8]
        out += [(d, min(i, j), max(i, j)) for d, j in near]
    return out


def tidy(edges):
    best = {}
    for w, a, b in edges:
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = min(w, best.get(key, w))
    return [(w, a, b) for (a, b), w in best.items()]


@pytest.mark.parametrize("kind", ["points", "rising", "ties", "parts"])
def test_merge_trees(spark, kind):
    edges = tidy(graph(kind, 120))
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double").repartition(3)
    got = H.merge_tree(H.forest(df)).orderBy("e").collect()
    want = walked(edges)
    assert [(r.w, r.size) for r in got] == [(m[0], m[5]) for m in want]
    size = lambda n: want[n[1]][5] if isinstance(n, tuple) else 1
    assert [r.larger for r in got] == [max(size(m[3]), size(m[4])) for m in want]


@pytest.mark.parametrize("kind", ["points", "ties", "parts"])
def test_condensed_trees(spark, kind):
    edges = tidy(graph(kind))
    label, stabilities = brute_condensed(edges, 7)
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double").repartition(3)
    made = H.condense(H.forest(df), 7)
    clusters = {r.cluster: r for r in made.clusters.collect()}
    assert sorted(r.stability for r in clusters.values()) == pytest.approx(stabilities)
    groups = {}
    for r in made.rows.collect():
        if r.cluster is not None and clusters[r.cluster].chosen is not None:
            groups.setdefault(clusters[r.cluster].chosen, []).append(r.id)
    assert {i: min(g) for g in groups.values() for i in g} == label


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.5)], "a long, b long, w double")
    made = H.condense(H.forest(df), 3)
    assert made.clusters.count() == 0


def test_hdbscan_of_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 9 + i / 100, 0.0]) for i in range(30)], "id long, vec array<double>")
    got = {r.id: r.cluster for r in K.hdbscan(df, 3, 5, 6).collect()}
    assert got == {i: i % 2 for i in range(30)}
    assert [r.cluster for r in K.hdbscan(df.where("id = 3"), 3, 5, 6).collect()] == [-1]


@pytest.mark.parametrize("kind", ["sphere", "clusters", "equal"])
def test_projection_index_recall(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    if kind == "sphere":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clusters":
        x = rng.normal(size=(20, 24))[rng.integers(0, 20, 1500)] * 3 + x * 0.3
    if kind == "line":
        x = np.outer(rng.random(1500), rng.normal(size=24))
    if kind == "equal":
        x[:600] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    index = ProjectionIndex(df.where("id < 1200"))
    index.add(df.where("id >= 1200"))
    got = {}
    for r in index.nearest(df.where("id % 20 = 0"), 10).collect():
        got.setdefault(r.q, []).append((r["rank"], r.v, r.distance))
    hits = total = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and [r[2] for r in rows] == pytest.approx(d[[r[1] for r in rows]])
        total += 10
        hits += int((np.array([r[2] for r in rows]) <= np.sort(d)[9] + 1e-9).sum())
    assert hits / total >= 0.9


def test_projection_index_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [5.0, 5.0]), (3, None), (None, [0.0, 0.0])], "id long, vec array<double>")
    got = [(r.q, r.v, r.distance) for r in ProjectionIndex(df).nearest(df, 5).collect()]
    assert sorted(got) == [(1, 2, 1.0), (2, 1, 1.0)]


def partition(labels):
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, set()).add(i)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("linkage", ["complete", "average", "ward"])
def test_agglomeration_of_all_rows(spark, linkage, monkeypatch):
    n = 60
    monkeypatch.setattr(H, "LAST", 12)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(8, 5))[rng.integers(0, 8, n)] * 3 + rng.normal(size=(n, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    tree = H.agglomerate(K.all_distances(df), linkage)
    want = K.merges(x, np.ones(n), linkage)
    heights = sorted(r.height for r in tree.collect())
    scale = heights[0] / sorted(h for *_, h in want)[0]  # ward's heights come in another unit
    assert heights == pytest.approx([scale * h for h in sorted(h for *_, h in want)])
    for k in (8, 20):
        labels = {r.id: r.cluster for r in H.tree_cut(df, tree, k).collect()}
        whole = K._cut_tree(n, want, k)
        assert partition(labels) == partition(dict(enumerate(whole.tolist())))
    if linkage == "ward":
        assert partition({r.id: r.cluster for r in K.hierarchical(df, None, linkage).collect()}) == partition({r.id: r.cluster for r in K.hierarchical(df, None, linkage, most=500).collect()})


def test_agglomeration_of_ties_and_few_rows(spark):
    df = spark.createDataFrame([(i, [float(i // 2)]) for i in range(9)], "id long, vec array<double>")
    tree = H.agglomerate(K.all_distances(df), "complete").collect()
    assert len(tree) == 8 and sorted(r.height for r in tree)[:4] == [0.0] * 4 and max(r.size for r in tree) == 9
    one = df.where("id = 3")
    assert [(r.id, r.cluster) for r in K.hierarchical(one, 2, "ward").collect()] == [(3, 3)]
    assert K.hierarchical(df.where("id < 0"), 2, "ward").count() == 0


def brute_order(edges):
    """Rows of each tree to their place and the edge they are entered by: the lightest edge out of what was visited."""
    around = {}
    for w, a, b in edges:
        around.setdefault(a, []).append((w, min(a, b), max(a, b), b))
        around.setdefault(b, []).append((w, min(a, b), max(a, b), a))
    out, left = {}, set(around)
    while left:
        start = min(left)
        seen, place = {start: None}, {start: 0}
        while True:
            out_edges = [e for v in seen for e in around[v] if e[3] not in seen]
            if not out_edges:
                break
            e = min(out_edges)
            place[e[3]], seen[e[3]] = len(seen), e[0]
        out |= {v: (start, place[v], seen[v]) for v in seen}
        left -= set(seen)
    return out


@pytest.mark.parametrize("kind", ["points", "star", "parts"])
def test_orderings(spark, kind):
    edges = tidy(graph(kind, 100))
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double").repartition(3)
    got = {r.id: (r.start, r.position, r.reach) for r in H.ordering(H.forest(df)).collect()}
    assert got == brute_order(edges)


@pytest.mark.parametrize("kind", ["points", "ties"])
def test_valleys(spark, kind):
    edges = tidy(graph(kind, 150))
    merges = walked(edges)
    above = {n: m[0] for m in merges for n in m[3:5]}
    rows_of = lambda n: rows_of(merges[n[1]][3]) + rows_of(merges[n[1]][4]) if isinstance(n, tuple) else [n]
    want = {}
    for i in range(len(merges) - 1, -1, -1):  # deeper ones overwrite
        if merges[i][5] >= 4 and ("m", i) in above and merges[i][0] <= 0.7 * above["m", i]:
            want |= dict.fromkeys(rows_of(("m", i)), i)
    names = {v: min(i for i in want if want[i] == v) for v in set(want.values())}
    want = {i: names[v] for i, v in want.items()}
    df = spark.createDataFrame([(a, b, w) for w, a, b in edges], "a long, b long, w double").repartition(3)
    assert {r.id: r.cluster for r in H.valleys(H.forest(df), 0.3, 4).collect()} == want


def test_optics_places_every_row(spark):
    df = spark.createDataFrame([(i, [float(i % 3) * 9 + i / 100, 0.0]) for i in range(60)], "id long, vec array<double>")
    rows = sorted(K.optics(df, 3, 6, radius=1.0).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(60))
    assert [i for i, r in enumerate(rows) if r.reach is None] == [0, 20, 40]
    assert {r.id: r.cluster for r in rows} == {i: i % 3 for i in range(60)}


def test_chosen_of_deep_trees_takes_few_rounds(spark, monkeypatch):
    """A comb, a chain and a random tree of clusters by a walk; each level of the tree took a round before."""
    rng = random.Random(4)
    parent = {0: None, 1: 0, 2: 0, 1000: None, 2000: None, 2001: 2000}
    for i in range(3, 240, 2):  # the comb: one of two goes on
        parent[i], parent[i + 1] = i - 2 + rng.randrange(2) if i > 3 else 1, None
        parent[i + 1] = parent[i]
    for i in range(2002, 2060):
        parent[i] = i - 1
    for i in range(1001, 1120):
        parent[i] = 1000 + rng.randrange(i - 1000)
    own = {i: rng.random() * (30 if rng.random() < 0.1 else 1) for i in parent}
    kids = {}
    for i, p in parent.items():
        kids.setdefault(p, []).append(i)
    best, wins = {}, {}
    for i in sorted(parent, reverse=True):  # children have larger numbers
        under = sum(best[k] for k in kids.get(i, []))
        loses = i in kids and (under > own[i] or parent[i] is None)
        wins[i], best[i] = not loses, under if loses else own[i]
    want = {}
    for i in sorted(parent):
        above = want[parent[i]] if parent[i] is not None else None
        want[i] = above if above is not None else i if wins[i] else None
    calls, cut = [], H.cut
    monkeypatch.setattr(H, "cut", lambda df: calls.append(1) or cut(df))
    df = spark.createDataFrame([(i, p, 0.0, own[i]) for i, p in parent.items()], "cluster long, parent long, birth double, stability double").repartition(3)
    assert {r.cluster: r.chosen for r in H._chosen(df).collect()} == want
    assert len(calls) < 120


def test_projection_index_deals_blocks_to_tasks(spark):
    """Blocks are small in bytes and were left to few tasks, whose time grew with the square of the rows."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(4)
    index = ProjectionIndex(df)
    found = index._found(index._asked(df.where("id < 300").withColumn("reach", F.lit(9.0))), 3, True)
    assert index.parts >= 20 and found.rdd.getNumPartitions() == index.parts
    got = {}
    for r in found.collect():
        got.setdefault(r.q, set()).add((r.distance, r.v))
    for q, pairs in got.items():  # all rows lie within the reach: both composites name the true neighbours
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [v for _, v in sorted(pairs)[:3]] == np.argsort(d)[:3].tolist()
