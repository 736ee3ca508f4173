"""Neighbour search: exact scores, and recall against brute force."""

import numpy as np
from pyspark.sql import functions as F

from statloom.llm import neighbours


def brute(ids, x, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = u @ u[list(ids).index(q)]
        out[q] = [i for _, i in sorted((-round(v, 12), i) for i, v in zip(ids, s) if i != q)[:k]]
    return out


def test_the_most_frequent_length_is_searched(spark):
    rows = [(i, [1.0, float(i)]) for i in range(60)] + [(i, [1.0] * 3) for i in range(60, 70)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted({r.query_id for r in got}) == [0, 50] and len(got) == 10 and all(r.vec_id < 60 for r in got)


def test_clusters_cost_a_minority_of_the_parts(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 16))
    x = np.concatenate([c + 0.05 * rnd.normal(size=(60, 16)) for c in centres])
    router = neighbours.fit(x, 12, 5, 0.97)
    assert router.probes <= 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.search(df, F.col("vec_id") % 50 == 0).toPandas()
    want = brute(list(range(len(x))), x, range(0, len(x), 50), 5)
    assert sum(len(set(g["vec_id"]) & set(want[q])) for q, g in rows.groupby("query_id")) >= 0.9 * 5 * len(want)


def test_recall_with_several_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    got = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = got.toPandas()
    want = brute(pdf["vec_id"].tolist(), np.stack(pdf["embedding"]).astype(float), [i for i in pdf["vec_id"] if i % 50 == 0], 5)
    rows = neighbours.search(got, F.col("vec_id") % 50 == 0).toPandas()
    hits = sum(len(set(g["vec_id"]) & set(want[q])) for q, g in rows.groupby("query_id"))
    assert hits >= 0.9 * sum(map(len, want.values()))
    x = dict(zip(pdf["vec_id"], pdf["embedding"]))
    for r in rows.itertuples():
        a, b = np.array(x[r.query_id], float), np.array(x[r.vec_id], float)
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [0.0, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 9), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 9)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_finite_vectors_of_any_size(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(120, 4))
    want = neighbours.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    want = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in want}
    sizes = 2.0 ** rnd.integers(-1000, 1000, 120)  # powers of two change no bit of a cosine
    for scale in (np.full(120, 2.0**-1000), np.full(120, 2.0**1000), sizes):
        df = spark.createDataFrame([(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, scale))], "vec_id long, embedding array<double>")
        got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    tiny = spark.createDataFrame([(0, [5e-324, 0.0]), (1, [1e308, 1e308]), (2, [0.0, 1e-300])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, round(r.score, 9)) for r in neighbours.search(tiny, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, round(0.5**0.5, 9)), (2, 0.0)]
