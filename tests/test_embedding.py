"""Path lengths and positions of all rows against brute force over all pairs."""

import numpy as np
import pytest

from statloom.operators import embedding as M


def floyd(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for m in range(n):
        d = np.minimum(d, d[:, m : m + 1] + d[m : m + 1, :])
    return d


def classical(d, k):
    j = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(values)[::-1][:k]
    return vectors[:, order] * np.sqrt(np.maximum(values[order], 0))


def pairs(y):
    return np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))


def table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)


def positions(df, n):
    got = {r.id: r.x for r in df.collect()}
    assert sorted(got) == list(range(n))
    return np.array([got[i] for i in range(n)])


def test_shortest_paths(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 300, 700), rng.integers(0, 290, 700), rng.random(700).round(2))]
    edges = [(a, b, w) for a, b, w in edges if a // 100 == b // 100] + [(5, 5, 0.0)]
    df = spark.createDataFrame(edges, "a long, b long, w double").repartition(3)
    sources = spark.createDataFrame([(0,), (7,), (150,), (295,), (7,)], "source long")
    got = {(r.source, r.id): r.d for r in M.shortest_paths(df, sources).collect()}
    d = floyd(300, edges)
    want = {(s, i): d[s, i] for s in (0, 7, 150, 295) for i in range(300) if np.isfinite(d[s, i])}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_scaling_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 6))
    for landmarks in (200, 30):
        y = positions(M.landmark_mds(table(spark, x), 2, landmarks), 200)
        assert np.allclose(pairs(y), pairs(x), atol=1e-6)  # two dimensions hold all of it


def test_isomap_unrolls_a_sheet(spark):
    rng = np.random.default_rng(3)
    t, h = rng.uniform(1.5 * np.pi, 4.5 * np.pi, 160), rng.uniform(0, 6, 160)
    x = np.stack((t * np.cos(t), h, t * np.sin(t)), axis=1)
    df = table(spark, x)
    d = pairs(x)
    edges = [(i, j, d[i, j]) for i in range(160) for j in np.argsort(d[i])[1:9].tolist()]
    paths = floyd(160, edges)
    assert np.isfinite(paths).all()
    y = positions(M.isomap(df, 2, 8, landmarks=160), 160)
    assert np.allclose(pairs(y), pairs(classical(paths, 2)), atol=1e-6)  # all rows are landmarks
    some = positions(M.isomap(df, 2, 8, landmarks=40), 160)
    assert np.corrcoef(pairs(some).ravel(), paths.ravel())[0, 1] > 0.97


def test_parts_and_few_rows(spark):
    x = np.concatenate([np.random.default_rng(4).normal(size=(20, 3)) + [30 * c, 0, 0] for c in range(4)])
    y = positions(M.isomap(table(spark, x), 2, 4, landmarks=3), 80)
    assert np.isfinite(y).all()
    centres = np.array([y[20 * c : 20 * c + 20].mean(axis=0) for c in range(4)])
    assert pairs(centres)[np.triu_indices(4, 1)].min() > 10
    assert M.isomap(table(spark, x).where("id < 0")).count() == 0
