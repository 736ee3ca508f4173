"""Operators on typed-in samples."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statloom.functions import text, vec
from statloom.operators import dataset, metrics, neighbors, stats, terms
from statloom.plans.graph import connected_components
from statloom.streaming.drift import ADWIN, DDM


def test_auc_with_weights(spark):
    rows = [(0.2, 1, 3.0), (0.4, 0, 2.0), (0.6, 1, 1.0), (0.7, 0, 1.0), (0.9, 1, 1.0), (1.0, 0, 1.0)]
    df = spark.createDataFrame(rows, "s double, y int, w double")
    # pairs of a positive above a negative, by weight: (0.6: 2) + (0.9: 2 + 1) of 5 * 4
    assert metrics.auc(df, "y", "s", "w").first().auc == pytest.approx(5 / 20)


def test_adjusted_rand(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1, 1, 2, 2, 2], [0, 0, 1, 1, 1, 1, 2, 2, 3])), "l int, c int")
    got = {r.metric: r.value for r in metrics.cluster_agreement(df, "l", "c").collect()}
    assert got["ari"] == pytest.approx(0.46, abs=0.005)


def test_moments_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (6.0,)], "x double")
    r = stats.moments(df, "x").first()
    assert (r.n, r.mean, r.min, r.max) == (3.0, 3.0, 1.0, 6.0)
    assert r.variance == pytest.approx(14 / 3, abs=1e-6)


def test_prefix_sums_over_many_values(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"), F.lit(1).alias("one"))
    got = {r.v: r.upto_one for r in stats.prefix_sums(df, "v", ["one"], rows=50).collect()}
    assert got == {v: v + 1 for v in range(1000)}


def test_exact_split_sizes(spark):
    df = spark.range(101).withColumnRenamed("id", "k")
    n = {r.split: r["count"] for r in dataset.exact_split(df, "k", [0.5, 0.25]).groupBy("split").count().collect()}
    assert n == {0: 50, 1: 26, -1: 25} or n == {0: 50, 1: 25, -1: 26}


def test_ngrams(spark):
    got = spark.range(1).select(text.all_ngrams(text.tokens(F.lit("The dog barked")), 3).alias("g")).first().g
    assert got == ["the", "dog", "barked", "the dog", "dog barked", "the dog barked"]


def test_vector_median(spark):
    r = spark.sql("select array(3D, 1D, 2D) a, array(4D, 1D, 2D, 3D) b").select(vec.median(F.col("a")), vec.median(F.col("b"))).first()
    assert tuple(r) == (2.0, 2.5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dbscan_finds_two_grids(spark):
    rows = [(i, [float(i % 3) * 0.1, float(i // 3) * 0.1]) for i in range(9)] + [(100 + i, [5 + float(i % 3) * 0.1, 0.1 * (i // 3)]) for i in range(9)] + [(999, [50.0, 50.0])]
    got = {r.id: r.cluster for r in neighbors.dbscan(spark.createDataFrame(rows, "id long, vec array<double>"), 0.15, 3).collect()}
    assert {got[i] for i in range(9)} == {0} and {got[100 + i] for i in range(9)} == {100} and got[999] == -1


def test_drift_is_seen():
    rnd = random.Random(123)
    d = DDM()
    states = [d.add(rnd.random() < 0.9) for _ in range(300)]
    assert "drift" not in states
    assert "drift" in [d.add(rnd.random() < 0.5) for _ in range(80)]
    a = ADWIN()
    assert not any(a.add(rnd.gauss(0, 1)) for _ in range(500))
    assert any(a.add(rnd.gauss(4, 1)) for _ in range(200))


def test_long_documents_are_counted_in_time(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(20_000)), "b a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    terms.term_counts(docs.where("doc_id > 0"), "doc_id", "text", unique=True, length=True).collect()
    began = time.time()
    got = {(r.doc_id, r.token): (r.tf, r.len) for r in terms.term_counts(docs, "doc_id", "text", unique=True, length=True).collect()}
    assert time.time() - began < 20
    want = {(0, w): (n, 20_000) for w, n in Counter(texts[0].split()).items()} | {(1, "a"): (1, 3), (1, "b"): (2, 3)}
    assert got == want
