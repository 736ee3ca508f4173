"""Clustering, transforms, outliers, neighbours and densities against brute force and known answers."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import density
from statloom.models import base, linear, online
from statloom.operators import clustering as K
from statloom.operators import features as X
from statloom.operators import neighbors, outliers
from statloom.plans.lineage import cut
from statloom.sources import container, corpus, generated


@pytest.fixture(scope="module")
def cells(spark):
    """Ten cells of forty rows."""
    return cut(generated.grid(spark, (2, 5), 40, 0.15, seed=12).select("id", F.col("features").alias("vec"), "label"))


def pure(df, cells, noise=0.05, least=10):
    """Whether every found cluster lies in one cell and all cells are found."""
    rows = df.join(cells.select("id", "label"), "id").collect()
    homes = collections.defaultdict(set)
    for r in rows:
        if r.cluster >= 0:
            homes[r.cluster].add(r.label)
    assert len(rows) == cells.count()
    assert sum(r.cluster < 0 for r in rows) <= noise * len(rows)
    assert all(len(v) == 1 for v in homes.values())
    assert len({next(iter(v)) for v in homes.values()}) == 10 and len(homes) >= least


@pytest.mark.parametrize("method", ["kpp", "kbb", "farthest_first"])
def test_kmeans_finds_the_cells(cells, method):
    c = K.kmeans(cells, 10, start=method, seed=4)
    assert K.inertia(cells, c) < 0.045 * 400 or method == "kpp"
    if method == "farthest_first":
        pure(K.assign(cells, c), cells)


def test_more_kmeans(cells):
    assert K.inertia(cells, K.minibatch_kmeans(cells, 10, 15, 0.3, seed=1)) < 0.3 * 400
    assert len(K.seeds(cells, 7, "mean_quantiles")) == 7 and len(K.seeds(cells, 7, "random")) == 7
    found = K.kernel_kmeans(cells, 10, online.rbf(0.4), 60, seed=2)
    assert found.select("cluster").distinct().count() >= 6


def test_numbers_of_clusters(spark):
    x = cut(generated.gaussian_classes(spark, 60, [[0, 0], [9, 0], [0, 9]], 0.5, seed=1).select("id", F.col("features").alias("vec"), "label"))
    assert K.kmeans_by_pdn(x, 5)[0] == 3
    assert K.gap_statistic(x, 5, 2)[0] == 3
    assert len(K.xmeans(x, 8)) == 3 and len(K.gmeans(x, 8, critical=4.0)) == 3
    for labels in (K.bayesian_hierarchy(x, most=60), K.mean_shift(x, 2.0), K.divisive(x, 3), K.divisive(x, 3, "local")):
        homes = collections.defaultdict(set)
        for r in labels.join(x, "id").collect():
            homes[r.cluster].add(r.label)
        assert all(len(v) == 1 for v in homes.values()) and len(homes) >= 3
    mix, mu, var = K.gaussian_mixture(x, 3, seed=5)
    assert abs(mix.sum() - 1) < 1e-9
    bayes = K.gaussian_mixture(x, 6, bayes=True, seed=5)
    assert K.mixture_assign(x, bayes).select("cluster").distinct().count() <= 6


def test_density_methods(cells):
    pure(K.hdbscan(cells, 4, 10, 12), cells, noise=0.15)
    pure(K.optics(cells, 4, 12, radius=0.3), cells)
    pure(K.flame(cells, 12, 20, 3.0), cells, noise=0.1)
    pure(K.lsdbc(cells, 10, 6.0), cells, noise=0.3)
    pure(neighbors.dbscan(cells.select("id", "vec"), 0.2, 3), cells)


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "weighted", "centroid", "median", "ward"])
def test_linkages(cells, linkage):
    pure(K.hierarchical(cells, 10, linkage), cells)


def test_merges_against_brute_force():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(18, 3))
    for linkage, between in (("single", np.min), ("complete", np.max), ("average", np.mean)):
        groups = {i: [i] for i in range(18)}
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        for step, (a, b, h) in enumerate(K.merges(x, np.ones(18), linkage)):
            best = min(between(d[np.ix_(p, q)]) for i, p in groups.items() for j, q in groups.items() if i < j)
            assert abs(h - best) < 1e-9 and abs(between(d[np.ix_(groups[a], groups[b])]) - h) < 1e-9
            groups[18 + step] = groups.pop(a) + groups.pop(b)


def test_medoids(cells, spark):
    c, total = K.medoids(cells, 10)
    assert total < 0.2 * 400
    many = K.medoids(cells, 10, most=200, samples=3)
    assert many[1] < 0.25 * 400
    i, d = K.medoid(cells)
    x = {r.id: np.array(r.vec) for r in cells.collect()}
    means = {j: np.mean([np.linalg.norm(v - u) for u in x.values()]) for j, v in x.items()}
    assert abs(d - min(means.values())) < 1e-9 and means[i] == pytest.approx(d)
    reps, w, at = K.representatives(cells, 50)
    assert len(reps) == 50 and w.sum() == 400 and at.count() == 400


def test_spanning_forest(spark):
    rnd = np.random.default_rng(3)
    n = 30
    edges = [(i, j, float(round(rnd.uniform(), 6))) for i in range(n) for j in range(i) if rnd.uniform() < 0.3]
    got = K.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double")).collect()
    up = list(range(n))

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    want = []
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if root(a) != root(b):
            up[root(a)] = root(b)
            want.append(w)
    assert sorted(r.w for r in got) == sorted(want)


def test_coclusters(spark):
    rows = [(r, c, 5.0 if r % 3 == c % 3 else 0.05) for r in range(18) for c in range(12)]
    for scale in ("scale", "bistochastic"):
        left, right = K.coclusters(spark.createDataFrame(rows, "row long, column long, value double"), 3, scale)
        a, b = {r.row: r.cluster for r in left.collect()}, {r.column: r.cluster for r in right.collect()}
        assert all(a[i] == b[j] for i in a for j in b if i % 3 == j % 3) and len(set(a.values())) == 3
    one = [({0, 1}, {0, 1}), ({2}, {2})]
    assert K.consensus_score(one, one) == 1.0 and 0 < K.consensus_score(one, [({0, 1}, {0})]) < 1


# Neighbours.
def test_cover_joins_against_brute_force(spark):
    rnd = np.random.default_rng(1)
    x = np.concatenate((rnd.normal(size=(60, 4)) * 0.2 + 3, rnd.normal(size=(90, 4)), np.zeros((3, 4))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = {(r.q, r["rank"]): r.v for r in neighbors.knn_join(df, df, 4).collect()}
    for q in range(len(x)):
        order = sorted((round(d[q, v], 9), v) for v in range(len(x)) if v != q)[:4]
        assert [round(d[q, near[q, k + 1]], 9) for k in range(4)] == [o[0] for o in order]
    pairs = {(r.q, r.v) for r in neighbors.range_join(df, df, 0.8).collect()}
    assert pairs == {(i, j) for i in range(len(x)) for j in range(len(x)) if d[i, j] <= 0.8}
    few = df.where("id < 3")
    assert neighbors.knn_join(few, few, 5).count() == 6
    assert neighbors.knn_join(df.limit(0), df.limit(0), 5).count() == 0 and neighbors.range_join(df.limit(0), df.limit(0), 1.0).count() == 0
    hashed = {(r.q, r.v) for r in neighbors.hashed_range_join(df, df, 0.8, tables=12, hashes=3).collect()}
    assert hashed <= pairs and len(hashed) >= 0.9 * len(pairs)
    rough = {(r.q, r.v) for r in neighbors.hashed_knn_join(df, df, 4, 12, 3).collect()}
    true = {(q, v) for (q, _), v in near.items()}
    assert len(rough & true) >= 0.8 * len(true)
    assert len({(r.q, r.v) for r in neighbors.ball_cover_one_shot(df, df, 4).collect()} & true) >= 0.8 * len(true)


def test_cover_skips_far_cells(spark):
    x = cut(generated.gaussian_classes(spark, 60, [[20.0 * i, 0.0] for i in range(10)], 0.3, seed=2).select("id", F.col("features").alias("vec")))
    cover = neighbors.Cover(x)
    asks = cover.asks(x, cover.visited(1.0)).count()
    assert len(cover.pivots) >= 5 and asks < 0.7 * 600 * len(cover.pivots)


# Outliers.
def test_outliers(spark):
    x = generated.gaussian_classes(spark, 200, [[0.0, 0.0]], 1.0, seed=7).select("id", F.col("features").alias("vec"))
    far = spark.createDataFrame([(1000 + i, [8.0 + i, -8.0]) for i in range(3)], "id long, vec array<double>")
    both = cut(x.unionByName(far))
    top = lambda df, c, asc=False: {r.id for r in df.orderBy(F.col(c) if asc else F.desc(c)).limit(3).collect()}
    assert top(outliers.IsolationForest(40, 64).fit(both).score(both), "score") == {1000, 1001, 1002}
    assert {1001, 1002} <= top(outliers.local_outlier_probability(both, 10), "loop")
    fit = density.robust_normal(both)
    assert top(outliers.density_outliers(both, fit.log_pdf, 0.02), "score", True) == {1000, 1001, 1002}
    assert np.linalg.norm(fit.mean) < 0.4
    shifted = cut(both.withColumn("vec", F.transform("vec", lambda v: v + 6)))
    one = outliers.OneClassSvm(0.05).fit(shifted).score(shifted)
    assert one.where("score < 0").count() <= 0.12 * 203


# Transforms.
def test_transforms(spark):
    x = cut(generated.gaussian_classes(spark, 200, [[1e6, 2.0, 3.0]], 1.0, seed=9).withColumn("features", F.zip_with("features", F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), lambda a, b: a * b)))
    p = np.array([r.features for r in x.orderBy("id").collect()])
    mean, cov, n = X._moments(x)
    assert n == 200 and np.allclose(mean, p.mean(axis=0)) and np.allclose(cov, np.cov(p.T, bias=True), atol=1e-6)
    back = lambda t: np.array([r.features for r in t.fit(x).inverse_transform(t.transform(x)).orderBy("id").collect()])
    for t in (X.Center(), X.Standard(), X.Pca(), X.Pca(whiten=True), X.Pca(zca=True), X.FastIca(3), X.TruncatedSvd(3)):
        assert np.allclose(back(t), p, rtol=1e-5), t
    out = np.array([r.features for r in X.Pca(2).fit(x).transform(x).collect()])
    assert out.shape == (200, 2) and abs(np.corrcoef(out.T)[0, 1]) < 1e-6
    for mode in ("gauss", "binary", "sparse", "sparse_sqrt", "sparse_log"):
        wide = cut(spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.sin(i * F.col("id") + i)).alias("features")))
        y = np.array([r.features for r in X.RandomProjection(60, mode, 1).fit(wide).transform(wide).orderBy("id").collect()])
        z = np.array([r.features for r in wide.orderBy("id").collect()])
        a, b = np.linalg.norm(y[:20] - y[20:], axis=1), np.linalg.norm(z[:20] - z[20:], axis=1)
        assert np.abs(a / b - 1).mean() < 0.25
    assert X.Remove([1]).apply(p).shape == (200, 2) and X.Polynomial(2, True).apply(p[:, :2]).shape == (200, 6)
    skewed = x.withColumn("features", F.array(F.exp(F.element_at("features", 2))))
    assert X.AutoDeskew().fit(skewed).chosen[0] == 1
    assert np.array([r.features for r in X.KernelPca(online.rbf(2.0), 2, 50).fit(x).transform(x).collect()]).shape == (200, 2)
    k = X.KernelFeatures(online.rbf(2.0), 50).fit(x)
    assert np.allclose(k.apply(p[:5]) @ k.apply(p[:5]).T, online.rbf(2.0)(p[:5], p[:5]), atol=0.2)


def test_ica_parts_sources(spark):
    x = cut(spark.range(800).select("id", F.sin(F.col("id") / 7).alias("s"), (F.col("id") % 23 / 11.0 - 1).alias("t")).select("id", F.array(F.col("s") + F.col("t"), F.col("s") - 0.5 * F.col("t")).alias("features"), "s", "t"))
    for contrast in ("log_cosh", "exp", "kurtosis"):
        rows = X.FastIca(2, contrast).fit(x).transform(x).collect()
        y, s, t = np.array([r.features for r in rows]), np.array([r.s for r in rows]), np.array([r.t for r in rows])
        c = np.abs(np.corrcoef(np.column_stack((y, s, t)).T)[:2, 2:])
        assert c.max(axis=0).min() > 0.97


def test_missing(spark):
    x = generated.linear(spark, 200, [1.0, 2.0], seed=1)
    gone = X.insert_missing(x, 0.3)
    share = gone.agg(F.avg(F.isnan(F.element_at("features", 1)).cast("double"))).first()[0]
    assert 0.2 < share < 0.4
    for how in ("mean", "median"):
        assert X.impute_features(gone, how).where(F.exists("features", F.isnan)).count() == 0


def test_selection(spark):
    x = cut(generated.linear(spark, 120, [0.0, 3.0, 0.0, -2.0], 0.01, seed=3))
    one = linear.Ridge(0.0)
    assert sorted(X.forward_selection(one, x, 2, folds=2, regression=True)) == [1, 3]
    assert X.backward_selection(one, x, 2, loss=0.01, folds=2, regression=True) == [1, 3]
    assert X.bidirectional_selection(one, x, 2, folds=2, regression=True) == [1, 3]
    assert X.plus_minus_selection(one, x, 2, 1, 2, folds=2, regression=True) == [1, 3]
    y = x.withColumn("label", (F.element_at("features", 2) > 0.5).cast("double"))
    w = X.relief(y, 3)
    assert int(np.argmax(w)) == 1
    piped = X.Piped(X.Pca(), one).fit(x)
    assert base.rmse(piped.transform(x)) < 0.05


def test_embeddings(spark):
    x = cut(generated.gaussian_classes(spark, 25, [[0, 0, 0], [10, 0, 0]], 0.3, seed=1).select("id", F.col("features").alias("vec")))
    p = np.array([r.vec for r in x.orderBy("id").collect()])
    for y in (X.classical_mds(x), X.isomap(x, neighbours=6), X.tsne(x, perplexity=8, rounds=250), X.tsne(x, perplexity=8, rounds=150, negative=7.0)):
        q = np.array([r.x for r in y.orderBy("rep").collect()])
        near = np.argsort(np.linalg.norm(q[:, None] - q[None], axis=2), axis=1)[:, 1:4]
        assert np.mean((near % 2) == (np.arange(50)[:, None] % 2)) > 0.8
    mds = np.array([r.x for r in X.classical_mds(x, 3).orderBy("rep").collect()])
    d = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
    assert np.allclose(d(mds), d(p), atol=1e-6)


# Densities and sources.
def test_densities(spark):
    rnd = np.random.default_rng(2)
    p = rnd.normal(size=(80, 2))
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(p)], "id long, vec array<double>")
    q = x.where("id < 10")
    d = np.linalg.norm(p[:10, None] - p[None], axis=2)
    got = {r.id: r.density for r in density.metric_kde(q, x, 0.9).collect()}
    want = np.where(d <= 0.9, 0.75 * (1 - (d / 0.9) ** 2), 0).mean(axis=1) / 0.9
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(10))
    h = np.array([0.5, 0.8])
    z = ((p[:10, None] - p[None]) / h) ** 2
    want = np.exp(-z.sum(axis=2) / 2).mean(axis=1) / (h.prod() * 2 * math.pi)
    got = {r.id: r.density for r in density.product_kde(q, x, h.tolist(), block=20).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(10))
    s = density.NormalM(np.array([1.0, -1.0]), np.array([[2.0, 0.5], [0.5, 1.0]])).sample(spark, 3000, 1)
    back = density.NormalM.fit(s)
    assert np.allclose(back.mean, [1, -1], atol=0.15) and np.allclose(back.covariance, [[2, 0.5], [0.5, 1]], atol=0.2)


def test_container_types(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 300.0, 0.5, 0.1, "é", 2.0), (2.0, -5.0, 0.25, 1 / 3, None, 1.0), (float("nan"), 7.0, 1.0, 0.2, "b", 1.0)], "a double, b double, c double, d double, k string, w double")
    path = f"file://{tmp_path}/box"
    container.write(df, path, ["a", "b", "c"], ["k"], target="d", weight="w")
    kinds = {r["name"]: (r.role, r.storage) for r in container.manifest(spark, path).collect()}
    assert kinds == {"a": ("numeric", "fp32"), "b": ("numeric", "short"), "c": ("numeric", "fp32"), "d": ("target", "fp64"), "k": ("category", ""), "w": ("weight", "byte")}
    key = lambda r: (r.b, r.c, r.d, r.k, r.w)
    assert sorted(map(key, container.read(spark, path).collect()), key=str) == sorted(map(key, df.collect()), key=str)


def test_corpus(spark, tmp_path):
    for label, name, text in (("pos", "a.txt", "Good good day"), ("neg", "b.txt", "bad day")):
        (tmp_path / label).mkdir(exist_ok=True)
        (tmp_path / label / name).write_text(text)
    docs = corpus.read_files(spark, f"file://{tmp_path}", labelled=True)
    assert {(r.label, r.text) for r in docs.collect()} == {("pos", "Good good day"), ("neg", "bad day")}
    words = corpus.vocabulary(docs)
    assert {r.token: r.df for r in words.collect()} == {"good": 1, "bad": 1, "day": 2}
    vec = {r.label: sorted(r.vec.values()) for r in corpus.vectors(docs, "label", words).collect()}
    assert vec == {"pos": [1.0, 2.0], "neg": [1.0, 1.0]}
    idf = {r.label: sorted(r.vec.values()) for r in corpus.hashed_vectors(docs, "label", idf=True).collect()}
    assert idf["pos"] == pytest.approx([0.0, 2 * math.log(2)])


def test_drift_stream(spark, tmp_path):
    from statloom.streaming import carried, drift

    rows = [(i, "a", (i * 7919) % 100 < (80 if i < 400 else 30)) for i in range(600)]
    df = spark.createDataFrame(rows, "i long, k string, ok boolean")
    want = [(r.at, r.state) for r in drift.ddm(df, "k", ["i"], "ok").orderBy("at").collect()]
    assert any(s == "drift" and 400 < at <= 440 for at, s in want)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/s")
    got = carried.ddm(drift.read_stream(spark, f"file://{tmp_path}/s"), "k", ["i"], "ok")
    assert sorted((r.at, r.state) for r in got.collect()) == sorted(want)
    cuts = drift.adwin(df.select("i", "k", F.col("ok").cast("double").alias("x")), "k", ["i"], "x").collect()
    assert cuts and min(r.at for r in cuts) > 400


def test_lanczos_and_spread(spark):
    rnd = np.random.default_rng(4)
    p = rnd.normal(size=(50, 6)) * np.arange(1, 7)
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(p)], "id long, vec array<double>, cluster int")
    values, vectors = X.lanczos(df.select(F.col("vec").alias("features")), 3, 6)
    want = np.linalg.eigvalsh(p.T @ p)[::-1][:3]
    assert np.allclose(values, want) and np.allclose(p.T @ (p @ vectors), vectors * values, atol=1e-6)
    for block in (5, 2048):
        for r in K.pairwise_spread(df, block=block).collect():
            q = p[np.arange(50) % 3 == r.cluster]
            d = np.linalg.norm(q[:, None] - q[None], axis=2)[np.triu_indices(len(q), 1)]
            assert abs(r["mean"] - d.mean()) < 1e-9 and abs(r.largest - d.max()) < 1e-9 and r.n == len(q)
