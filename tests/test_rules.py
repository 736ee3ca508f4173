"""Online rules with one worker against row-by-row versions written from their definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.models import online
from statloom.models.online import OnlineLinear

N, D = 150, 4


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(N, D))
    y = (x @ [1.0, -1.0, 0.5, 0.0] + 0.3 * rng.normal(size=N) > 0).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double").repartition(3)
    order = [r.id for r in df.orderBy(F.xxhash64("id")).select("id").collect()]
    return df, [(np.append(x[i], 1.0), 2 * y[i] - 1) for i in order]


def aggressive(mode):
    def learn(seen):
        w = np.zeros(D + 1)
        for x, y in seen:
            loss, n = max(0.0, 1 - y * w @ x), x @ x
            tau = {"PA": loss / n, "PA1": min(0.7, loss / n), "PA2": loss / (n + 1 / 1.4)}[mode]
            w = w + tau * y * x
        return w

    return learn


def second_order(kind, full):
    """Means and covariances as matrices; a diagonal learner keeps the diagonal of what the full one would."""
    phi = 1.2815515655446004  # the normal quantile of 0.9

    def learn(seen):
        w, s = np.zeros(D + 1), np.eye(D + 1)
        for x, y in seen:
            p, v = y * w @ x, x @ s @ x
            if kind == "arow":
                if p >= 1:
                    continue
                beta = 1 / (v + 0.8)
                w, s = w + max(0, 1 - p) * beta * y * s @ x, s - beta * np.outer(s @ x, s @ x)
            elif kind == "nherd":
                if p >= 1:
                    continue
                w, s = w + y * (1 - p) / (v + 1 / 0.9) * s @ x, np.linalg.inv(np.linalg.inv(s) + (2 * 0.9 + 0.81 * v) * np.outer(x, x))
            else:
                psi, zeta = 1 + phi**2 / 2, 1 + phi**2
                if phi * math.sqrt(v) - p <= 0:
                    continue
                alpha = min(0.6, max(0.0, (-p * psi + math.sqrt(p**2 * phi**4 / 4 + v * phi**2 * zeta)) / (v * zeta)))
                u = (-alpha * v * phi + math.sqrt(alpha**2 * v**2 * phi**2 + 4 * v)) ** 2 / 4
                beta = alpha * phi / (math.sqrt(u) + v * alpha * phi)
                w, s = w + alpha * y * s @ x, s - beta * np.outer(s @ x, s @ x)
            if not full:
                s = np.diag(np.diag(s)) if kind != "nherd" else s
        return w

    return learn


def pegasos(seen):
    w = np.zeros(D + 1)
    for t, (x, y) in enumerate(seen, 2):
        eta = 1 / (0.01 * t)
        hit = y * w @ x < 1
        w = np.append(w[:-1] * (1 - eta * 0.01), w[-1]) + (eta * y * x if hit else 0)
        w = w * min(1, 1 / (math.sqrt(0.01) * np.linalg.norm(w))) if w.any() else w
    return w


def alma(seen):
    w, k = np.zeros(D + 1), 1
    for x, y in seen:
        x = x / np.linalg.norm(x)
        if y * w @ x <= (1 - 0.9) / 0.9 / math.sqrt(k):
            w = w + math.sqrt(2) / math.sqrt(k) * y * x
            w, k = w / max(1, np.linalg.norm(w)), k + 1
    return w


def romma(seen):
    """The weights of least norm among those that keep the last product with themselves and meet the row's margin of one."""
    w = np.zeros(D + 1)
    for x, y in seen:
        if y * (w @ x) > 0:
            continue
        if not w.any():
            w = y * x / (x @ x)
            continue
        a = np.array([[w @ w, w @ x], [w @ x, x @ x]])
        c = np.linalg.solve(a, [w @ w, y])
        w = c[0] * w + c[1] * x
    return w


def dual(seen):
    w = np.zeros(D + 1)
    for x, y in seen:
        w = w + min(max((1 - y * w @ x) / (x @ x), 0), 0.5) * y * x
    return w


CASES = {
    "PA": (online.passive_aggressive(mode="PA"), aggressive("PA")),
    "PA1": (online.passive_aggressive(0.7, "PA1"), aggressive("PA1")),
    "PA2": (online.passive_aggressive(0.7, "PA2"), aggressive("PA2")),
    "arow": (online.arow(0.8), second_order("arow", False)),
    "arow_full": (online.arow(0.8, full=True), second_order("arow", True)),
    "scw": (online.scw(0.6), second_order("scw", False)),
    "scw_full": (online.scw(0.6, full=True), second_order("scw", True)),
    "nherd_full": (online.nherd(0.9, full=True), second_order("nherd", True)),
    "pegasos": (online.pegasos(0.01), pegasos),
    "alma2": (online.alma2(), alma),
    "romma": (online.romma(), romma),
    "dual": (online.dual_coordinate(0.5), dual),
}


@pytest.mark.parametrize("name", CASES)
def test_rules_equal_their_definitions(rows, name):
    df, seen = rows
    rule, definition = CASES[name]
    learner = OnlineLinear(rule, epochs=1, workers=1)
    learner.fit(df)
    assert learner.weights == pytest.approx(definition(seen), rel=1e-7, abs=1e-9)


def test_full_covariances_are_mixed(spark, rows):
    df, _ = rows
    model = OnlineLinear(online.arow(full=True), epochs=2, workers=3).fit(df)
    assert model.transform(df).where("prediction = label").count() > 0.85 * N
