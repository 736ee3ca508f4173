"""Top inner products against all products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import impact

SCHEMA = "vec_id long, embedding array<double>, v string, block int"


def brute(rows, top=5, every=50, clip=True):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    sizes = [len(v) for _, v in good]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s))
    floor = lambda x: math.floor(256 * x) if abs(x) < 2.0**900 else int(x) * 256
    good = [(i, [floor(x) for x in v], v) for i, v in good if len(v) == size]
    out = []
    for q in sorted({i for i, _, _ in good if i % every == 0}):
        mine = min((v, n) for i, n, v in good if i == q)[1]
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v, _ in good if i != q)[:top]
        out += [(q, r, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(scored, 1)]
    return out


def found(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in impact.top_products(df, F.col("vec_id") % 50 == 0).collect())


def random_rows(kind, n=900, dims=12):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, dims))
    if kind == "sparse":
        x *= rng.random((n, dims)) < 0.2
    if kind == "positive":
        x = np.abs(x)
    if kind == "negative":
        x[:, :] = -np.abs(x)
        x[::50] *= -1
    if kind == "ties":
        x = np.round(x)
    if kind == "clusters":
        x = rng.normal(size=(9, dims))[rng.integers(0, 9, n)] + 0.1 * x
    if kind == "wild":
        x *= 10.0 ** rng.integers(-3, 4, (n, 1))
    return [(i, v.tolist()) for i, v in enumerate(x / 3)]


@pytest.mark.parametrize("kind", ["normal", "sparse", "positive", "negative", "ties", "clusters", "wild"])
def test_all_products(spark, monkeypatch, kind):
    monkeypatch.setattr(impact, "LEAST", 150)
    rows = random_rows(kind)
    assert found(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.0, 0.0]), (50, [1.0, 1.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]),
            (7, [1.0]), (8, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (100, None), (150, [-1.0, -0.001]), (9, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []


def test_numbers_of_any_size(spark):
    rows = [(i, [s * 10.0**e, -s * 3.0 ** (e % 7)]) for i, (e, s) in enumerate([(e, s) for e in (-300, -3, 0, 5, 9, 15, 17, 200, 307) for s in (1, -1)])]
    assert found(spark, rows) == brute(rows)


def test_reading_stops_on_proof():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    v = impact.whole(centres[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 16)), 256)
    index = impact.ImpactIndex(np.arange(4000), v)
    shares, sizes = zip(*[(share, len(left)) for left, share in (index.possible(v[i], index.ids != i, 5) for i in range(0, 4000, 200))])
    assert np.mean(sizes) < 600  # a cluster holds 200
    sparse = v * (rng.random(v.shape) < 0.1)
    index = impact.ImpactIndex(np.arange(4000), sparse)
    shares, sizes = zip(*[(share, len(left)) for left, share in (index.possible(v[i], index.ids != i, 5) for i in range(0, 4000, 200))])
    assert np.mean(shares) < 0.9 and np.mean(sizes) < 200
