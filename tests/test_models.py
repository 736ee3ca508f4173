"""Learners on generated problems with known answers: accuracy on rows they did not see, closed forms, brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.models import base, bayes, ensemble, kernels, linear, online, trees
from statloom.plans.lineage import cut
from statloom.sources import generated


@pytest.fixture(scope="module")
def two(spark):
    """Two well parted classes in seven dimensions."""
    means = [[1.0, 1.2, 2.5, -1.0, 0.5, 0.9, 0.1], [-0.9, -0.7, -0.3, 1.0, -0.5, -0.9, -0.1]]
    df = cut(generated.gaussian_classes(spark, 150, means, 0.7, seed=3))
    fold = base.fold_of(F.col("id"), 3)
    return cut(df.where(fold > 0)), cut(df.where(fold == 0))


@pytest.fixture(scope="module")
def four(spark):
    df = cut(generated.gaussian_classes(spark, 80, [[0, 0], [4, 0], [0, 4], [4, 4]], 0.6, seed=5))
    fold = base.fold_of(F.col("id"), 3)
    return cut(df.where(fold > 0)), cut(df.where(fold == 0))


@pytest.fixture(scope="module")
def rings(spark):
    df = cut(generated.circles(spark, 150, [1.0, 3.0], seed=2))
    fold = base.fold_of(F.col("id"), 3)
    return cut(df.where(fold > 0)), cut(df.where(fold == 0))


def held(learner, data):
    return base.accuracy(learner.fit(data[0]).transform(data[1]))


RULES = {
    "perceptron": online.perceptron(), "pa": online.passive_aggressive(mode="PA"), "pa1": online.passive_aggressive(), "pa2": online.passive_aggressive(mode="PA2"), "arow": online.arow(), "scw": online.scw(),
    "scw2": online.scw(mode="SCW2"), "cw": online.scw(mode="CW"), "nherd": online.nherd(), "alma2": online.alma2(), "romma": online.romma(), "aromma": online.romma(True), "hinge": online.sgd(), "log": online.sgd("logistic", l1=1e-4, l2=1e-4),
    "truncated": online.truncated_gradient(), "pegasos": online.pegasos(), "mirror": online.mirror_descent(), "dual": online.dual_coordinate(),
}


@pytest.mark.parametrize("name", sorted(RULES))
def test_online_rules(two, name):
    assert held(online.OnlineLinear(RULES[name], epochs=1, workers=2), two) >= 0.9


def test_online_regression_and_warm_start(spark):
    df = generated.linear(spark, 400, [1.0, -2.0, 0.5], seed=1)
    for rule in (online.passive_aggressive(eps=0.01), online.sgd("squared", rate=0.3), online.sgd("huber", rate=0.3)):
        assert base.rmse(online.OnlineLinear(rule, epochs=4, workers=2, regression=True).fit(df).transform(df)) < 0.25
    first = online.OnlineLinear(online.passive_aggressive(eps=0.01), epochs=4, workers=2, regression=True)
    first.fit(df)
    warm = online.OnlineLinear(online.passive_aggressive(eps=0.01), epochs=1, workers=2, regression=True, start=first.weights)
    cold = online.OnlineLinear(online.passive_aggressive(eps=0.01), epochs=1, workers=2, regression=True)
    assert base.rmse(warm.fit(df).transform(df)) <= base.rmse(cold.fit(df).transform(df)) + 1e-9


KERNEL_RULES = {
    "perceptron": (online.kernel_perceptron(), "project"), "forgetron": (online.kernel_perceptron(0.97), "remove"), "bogd": (online.kernel_sgd(), "random"), "merge": (online.kernel_sgd("logistic"), "merge"),
    "pegasos": (online.kernel_pegasos(), "remove"), "alma2": (online.kernel_alma2(), "stop"), "duol": (online.double_update(), "remove"), "oskl": (online.stochastic_keep(), "remove"),
}


@pytest.mark.parametrize("name", sorted(KERNEL_RULES))
def test_online_kernels(rings, name):
    rule, strategy = KERNEL_RULES[name]
    assert held(online.OnlineKernel(rule, online.rbf(0.7), 60, strategy, workers=2, epochs=2), rings) >= 0.85


def test_kernel_machines(rings, spark):
    k = online.rbf(0.7)
    for one in (kernels.least_squares_svm(k, 10.0, 60), kernels.kernel_svm(k, 10.0, 60), kernels.kernel_svm(k, 10.0, 60, bias=False), kernels.OnFeatures(base.logistic(), map_=kernels.random_fourier_map(2, 120, 0.7)), kernels.RbfNetwork(base.logistic(), 40), kernels.DivideAndConquerSvm(k, 2, 10.0, 40)):
        assert held(one, rings) >= 0.93
    x = generated.linear(spark, 300, [1.0, 2.0], seed=4).withColumn("label", F.sin(3 * F.element_at("features", 1)) + F.element_at("features", 2))
    for one in (kernels.kernel_ridge(online.rbf(0.5), 1e-4, 60), kernels.Kriging(points=60)):
        assert base.rmse(one.fit(x).transform(x)) < 0.1
    q = x.limit(40).select("id", "features")
    truth = {r.id: r.label for r in x.collect()}
    for got in (kernels.kernel_regression(x, q, online.rbf(0.08)), kernels.local_regression(x, q, 15)):
        rows = got.collect()
        assert len(rows) == 40 and max(abs(r.prediction - truth[r.id]) for r in rows) < 0.4
    vote = kernels.discriminant_neighbours(rings[0], rings[1].select("id", "features"), 5, 30)
    labels = {r.id: r.label for r in rings[1].collect()}
    assert sum(labels[r.id] == r.prediction for r in vote.collect()) >= 0.93 * len(labels)


def test_kernel_regression_is_the_weighted_mean(spark):
    x = generated.linear(spark, 60, [1.0, 2.0], seed=4)
    rows = x.orderBy("id").collect()
    p, y = np.array([r.features for r in rows]), np.array([r.label for r in rows])
    k = online.rbf(0.3)(p, p)
    want = k @ y / k.sum(axis=1)
    got = {r.id: r.prediction for r in kernels.kernel_regression(x, x, online.rbf(0.3), block=16).collect()}
    assert all(abs(got[r.id] - w) < 1e-9 for r, w in zip(rows, want))


def test_prototypes_and_maps(four):
    for one in (kernels.VectorQuantisation(2), kernels.VectorQuantisation(2, version="2.1"), kernels.VectorQuantisation(2, version="3"), kernels.SelfOrganisingMap(4, 4)):
        assert held(one, four) >= 0.93


def test_many_classes(four):
    pa = online.OnlineLinear(online.passive_aggressive(), epochs=2, workers=2)
    for one in (ensemble.OneVsAll(base.logistic()), ensemble.OneVsOne(base.logistic()), ensemble.OneVsOne(base.logistic(), path=True), ensemble.OneVsAll(pa), linear.SoftmaxRegression(), linear.Rocchio(), bayes.GaussianNaiveBayes(), bayes.MultivariateNormals(), base.perceptron_net([2, 5, 4])):
        assert held(one, four) >= 0.93


def test_ensembles(four, two):
    tree = base.decision_tree(depth=3)
    for one in (ensemble.Bagging(tree, 4), ensemble.Wagging(tree, 4), ensemble.AdaBoost(base.decision_tree(depth=2), 6, samme=True), ensemble.ArcX4(tree, 4), ensemble.Stacking([tree, linear.Rocchio()], base.logistic()), ensemble.MajorityVote([tree, linear.Rocchio()], soft=True), trees.ExtraTrees(5, 5, 2, tries=3), base.random_forest(8, 4)):
        assert held(one, four) >= 0.9
    stump = base.decision_stump()
    for one in (ensemble.AdaBoost(stump, 6), ensemble.ModestAdaBoost(stump, 6), ensemble.EmphasisBoost(stump, 6), ensemble.LogitBoost(base.regression_tree(depth=1), 6), ensemble.RegressorToClassifier(linear.Ridge(0.1)), linear.AveragedLogistic(3), linear.CoordinateDescent(logistic=True, l1=0.001), base.linear_svm(), base.boosted_trees(5), ensemble.PriorClassifier()):
        assert held(one, two) >= (0.9 if not isinstance(one, ensemble.PriorClassifier) else 0.4)


def test_averaging_regressors(spark):
    x = generated.linear(spark, 300, [1.0, -2.0], 0.05, seed=6)
    exact = linear.Ridge(0.0)
    assert base.rmse(exact.fit(x).transform(x)) < 0.07
    assert np.allclose(exact.weights, [1, -2, 0], atol=0.05)
    for one in (ensemble.AveragedRegressor([exact, base.elastic_net()]), ensemble.Bagging(exact, 3, regression=True), base.regression_tree(6), base.stochastic_gradient_boosting(15), trees.ExtraTrees(6, 6, 2, regression=True, tries=3), ensemble.Stacking([exact, base.regression_tree(3)], exact, regression=True)):
        assert base.rmse(one.fit(x).transform(x)) < 0.3
    wild = x.withColumn("label", F.when(F.col("id") % 5 == 0, 50.0).otherwise(F.col("label")))
    robust = linear.Ransac(linear.Ridge(0.0), tolerance=0.3, sample=6)
    assert abs(robust.fit(wild).transform(x).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]) < 0.1
    assert robust.agreeing >= 235


@pytest.mark.parametrize("mode", ["naive", "cv", "hold_out"])
def test_calibration(two, mode):
    for method in ("platt", "isotonic"):
        seen = ensemble.Calibrated(base.decision_tree(depth=2), method, mode).fit(two[0]).transform(two[1])
        loss = seen.select((F.element_at("probability", 2) - F.col("label")).alias("d")).agg(F.avg(F.col("d") * F.col("d"))).first()[0]
        assert loss < 0.15 and base.accuracy(seen) >= 0.85


def test_platt_solves_its_equations(spark):
    rnd = np.random.default_rng(1)
    s = rnd.normal(size=300)
    y = (rnd.uniform(size=300) < 1 / (1 + np.exp(-2 * s + 0.5))).astype(float)
    a, b = ensemble.platt_fit(spark.createDataFrame([(float(p), float(q)) for p, q in zip(s, y)], "score double, label double"))
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    p = 1 / (1 + np.exp(a * s + b))
    assert abs((s * (t - p)).sum()) < 1e-6 and abs((t - p).sum()) < 1e-6 and a < 0


def test_search(two):
    assert ensemble.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    drawn = ensemble.random_choices(5, 1, depth=[1, 2], rate=lambda u: 10**u)
    assert len(drawn) == 5 and all(d["depth"] in (1, 2) and 1 <= d["rate"] <= 10 for d in drawn)
    best = ensemble.Search(base.decision_tree, ensemble.grid(depth=[0, 2]))
    assert base.accuracy(best.fit(two[0]).transform(two[1])) >= 0.85
    assert best.tried[0][1] == {"depth": 2}
    seen = base.cross_validate(base.decision_tree(depth=2), two[0], "id", 3)
    assert seen.count() == two[0].count() and seen.select("id").distinct().count() == two[0].count()


def test_id3_and_pruning(spark):
    rows = [(float(a == "x" and b == "p"), a, b, c) for a in "xy" for b in "pq" for c in "uvw" for _ in range(5)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, label double, a string, b string, c string")
    model = trees.Id3(["a", "b", "c"]).fit(df)
    assert base.accuracy(model.transform(df)) == 1.0
    assert {n.column for n in model.root.inner()} == {"a", "b"}
    uses = trees.importance_by_uses([model])
    assert set(uses) == {"a", "b"} and abs(sum(uses.values()) - 1) < 1e-12
    noisy = df.withColumn("label", F.when(F.col("id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    grown = trees.Id3(["c", "a", "b"]).fit(noisy)
    n = len(grown.root.leaves())
    pruned = trees.prune(grown, df)
    assert len(pruned.root.leaves()) <= n and base.accuracy(pruned.transform(df)) >= 0.85
    again = trees.pessimistic_prune(trees.Id3(["c", "a", "b"]).fit(noisy))
    assert len(again.root.leaves()) <= n
    missing = spark.createDataFrame([(1, None, "p", "u")], "id long, a string, b string, c string")
    assert model.transform(missing).count() == 1


def test_importances(two):
    data = two[0].withColumn("features", F.array(F.element_at("features", 3), F.element_at("features", 7) * 0))
    model = trees.ExtraTree(3, features=2, tries=5, seed=1).fit(data)
    assert set(trees.impurity_importance([model])) == {0}
    drop = trees.permutation_importance(model, data, "id")
    assert drop[0] > 0.2 and abs(drop[1]) < 1e-12


def test_bayes_tables(spark):
    rows = [(i, float((i // 2) % 2), "a" if (i // 2) % 2 else "b", str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, label double, p string, q string")
    for one in (bayes.OneDependence(["p", "q"], "p"), bayes.AveragedOneDependence(["p", "q"]), bayes.BayesNetwork({"label": [], "p": ["label"], "q": ["label"]})):
        model = one.fit(df)
        assert base.accuracy(model.transform(df)) == 1.0
        assert all(abs(sum(r.probability) - 1) < 1e-9 for r in model.transform(df).collect())
        assert model.transform(df.limit(1).withColumn("p", F.lit(None).cast("string"))).count() == 1
    assert bayes.k2_structure(df, ["label", "p", "q"]) == {"label": [], "p": ["label"], "q": []}
    share = {(r.p, r.label): r.probability for r in bayes.conditional_table(df, "label", ["p"]).collect()}
    assert abs(share["a", 1.0] - 31 / 32) < 1e-12 and abs(share["a", 0.0] - 1 / 32) < 1e-12


def test_bayes_by_density(four):
    from statloom.functions.density import NormalM

    fit = lambda df: NormalM.fit(df.select(F.col("features").alias("vec")), 1e-6).log_pdf
    assert held(bayes.BestClassDistribution(fit), four) >= 0.93
    counts = four[0].withColumn("features", F.transform("features", lambda x: F.greatest(x + 3, F.lit(0.0))))
    assert held(bayes.MultinomialNaiveBayes(), (counts, counts)) >= 0.4


def test_gaussian_sums_merge(four):
    a, b = four[0].where("id % 2 = 0"), four[0].where("id % 2 = 1")
    whole, parts = bayes.GaussianSums.of(four[0]), bayes.GaussianSums.of(a, 4).merge(bayes.GaussianSums.of(b, 4))
    assert np.allclose(whole.mean, parts.mean) and np.allclose(whole.m2, parts.m2, rtol=1e-6)
    assert math.isclose(whole.n.sum(), 2 * four[0].count())


@pytest.mark.parametrize("updater", ["sgd", "momentum", "nesterov", "adagrad", "rmsprop", "adadelta", "adam", "rprop"])
def test_networks(rings, updater):
    from statloom.models.network import Network

    rate = {"sgd": 0.3, "momentum": 0.05, "nesterov": 0.05, "adagrad": 0.1}.get(updater, 0.01)
    net = Network((12,), "tanh", updater=updater, rate=rate, epochs=160 if updater == "adadelta" else 80, workers=1)
    assert held(net, rings) >= (0.6 if updater in ("adadelta", "rprop") else 0.93)


def test_network_options(rings, spark):
    from statloom.models import network

    for activation, how in (("relu", "gaussian"), ("softsign", "tanh"), ("sigmoid", "uniform")):
        net = network.Network((20,), activation, how, rate=0.02, epochs=40, l2=1e-5, most_norm=8.0, drop_hidden=0.05, workers=2)
        assert held(net, rings) >= 0.8, activation
    assert np.allclose(np.sqrt((network.max_norm(np.full((4, 2), 3.0), 1.0) ** 2).sum(axis=0)), 1)
    assert (network.start([2, 3], "constant", 0.5)[0][0] == 0.5).all()
    x = generated.linear(spark, 300, [1.0, -2.0], seed=6)
    one = network.Network((8,), regression=True, epochs=60, workers=1)
    assert base.rmse(one.fit(x).transform(x)) < 0.15


def test_multi_hyperplane_machines(rings, four):
    from statloom.models.machines import ConvexPolytope, MultiHyperplane

    assert held(MultiHyperplane(epochs=12), four) >= 0.93
    outside = ConvexPolytope(8, epochs=25)
    assert held(outside, rings) >= 0.85


def test_smote(spark):
    from statloom.operators.imbalance import borderline_smote, smote

    df = cut(generated.gaussian_classes(spark, 40, [[0.0, 0.0], [1.5, 0.0]], 0.8, seed=4).where("label = 0 or id < 40"))
    few = {r.id: np.array(r.features) for r in df.where("label = 1").collect()}
    rows = smote(df, 1.0, per_row=3, k=4).collect()
    assert len(rows) == 3 * len(few)
    for r in rows:  # on a segment between two rows of the class
        p = np.array(r.features)
        assert any(abs(np.linalg.norm(p - few[r.q]) + np.linalg.norm(p - q) - np.linalg.norm(few[r.q] - q)) < 1e-9 for q in few.values())
    edge = borderline_smote(df, 1.0, per_row=2, k=4, around=6)
    assert 0 < edge.count() <= 2 * len(few)
    assert borderline_smote(df, 1.0, per_row=2, k=4, around=6, towards_all=True).count() >= edge.count()


def test_multiclass_passive_aggressive(four):
    for support in (True, False):
        assert held(online.OnlineMulticlass(support=support, workers=2), four) >= 0.93
    assert held(kernels.LocalQuantisation(base.decision_tree(2), 2), four) >= 0.93
