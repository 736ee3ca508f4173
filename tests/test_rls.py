"""Recursive kernel least squares against kernel ridge regression of all rows."""

import numpy as np
import pytest

from statloom.models.online import rbf
from statloom.models.rls import KernelRls


def data(n=300):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, size=(n, 2))
    return x, np.sin(x[:, 0]) + 0.3 * x[:, 1] + 0.05 * rng.normal(size=n)


def table(spark, x, y, parts=6):
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double").repartition(parts, "id")


def predicted(model, df):
    return np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])


def test_near_kernel_ridge_and_smaller_with_the_tolerance(spark, monkeypatch):
    from statloom.models import rls

    monkeypatch.setattr(rls, "TOGETHER", 2)
    x, y = data()
    df, kernel = table(spark, x, y), rbf(1.0)
    k = kernel(x, x)
    want = k @ np.linalg.solve(k + 0.1 * np.eye(len(x)), y)
    sizes, errors = [], []
    for tolerance in (1e-6, 1e-3, 1e-1):
        learner = KernelRls(kernel, tolerance, penalty=0.1)
        errors.append(np.abs(predicted(learner.fit(df), df) - want).max())
        sizes.append(len(learner.dictionary))
    assert errors[0] < 1e-3 and errors[1] < 0.02 and errors[2] < 0.5
    assert 300 > sizes[0] > sizes[1] > sizes[2] > 3


def test_updates_go_on(spark):
    x, y = data()
    kernel = rbf(1.0)
    k = kernel(x, x)
    want = k @ np.linalg.solve(k + 0.1 * np.eye(len(x)), y)
    df = table(spark, x, y)
    learner = KernelRls(kernel, 1e-6, penalty=0.1)
    learner.fit(df.where("id < 100"))
    first = len(learner.dictionary)
    learner.update(df.where("id >= 100 and id < 200"))
    model = learner.update(df.where("id >= 200"))
    assert len(learner.dictionary) > first
    assert np.abs(predicted(model, df) - want).max() < 0.02


def test_bounds_and_empty_tables(spark):
    x, y = data(60)
    df = table(spark, x, y)
    with pytest.raises(Exception, match="raise the tolerance"):
        KernelRls(rbf(0.05), 1e-9, most=20).fit(df)
    assert set(predicted(KernelRls(rbf(1.0)).fit(df.where("id < 0")), df)) == {0.0}
