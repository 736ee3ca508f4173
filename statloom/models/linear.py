"""Linear models in closed form or by full-batch steps, each step one aggregation over all rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ArrayModel, Learner, Model, class_count, dimensions, fold_of


def array_sum(df: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of ``f(features, label, weight)``, an array of ``size`` numbers a batch.

    Each partition adds its batches and yields one array; the arrays are added
    by position in one aggregation.
    """
    rows = df.select("features", F.col("label").cast("double").alias("label"), (F.col("weight") if "weight" in df.columns else F.lit(1.0)).cast("double").alias("weight"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            if len(b):
                total += f(np.stack(b["features"]).astype(float), b["label"].to_numpy(), b["weight"].to_numpy()).ravel()
        yield pd.DataFrame({"v": [total]})

    made = rows.mapInPandas(task, "v array<double>").select(F.posexplode("v").alias("i", "x"))
    got = made.groupBy("i").agg(F.sum("x").alias("x")).collect()  # one row a position
    out = np.zeros(size)
    for r in got:
        out[r.i] = r.x
    return out


def normal_equations(df: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted ``X'X``, ``X'y`` and ``y'y`` with a last column of ones, in one pass."""

    def f(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.hstack((x, np.ones((len(x), 1)), y[:, None]))
        return (z * w[:, None]).T @ z

    m = array_sum(df, f, (d + 2) ** 2).reshape(d + 2, d + 2)
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1])


class Ridge(Learner):
    """Least squares with a squared penalty; by default the intercept is penalised too, and nothing is scaled.

    ``penalty`` 0 is multiple linear regression.
    """

    def __init__(self, penalty: float = 0.0, penalise_intercept: bool = True) -> None:
        self.penalty, self.penalise_intercept = penalty, penalise_intercept

    def fit(self, df: DataFrame) -> Model:
        d = dimensions(df)
        xx, xy, _ = normal_equations(df, d)
        p = self.penalty * np.eye(d + 1)
        if not self.penalise_intercept:
            p[-1, -1] = 0
        w = np.linalg.lstsq(xx + p, xy, rcond=None)[0]
        self.weights = w
        return ArrayModel(lambda x: x @ w[:-1] + w[-1])


class CoordinateDescent(Learner):
    """Elastic-net least squares or logistic regression by coordinate descent.

    Least squares works on the normal equations alone. Logistic regression
    repeats it on the weighted equations of each Newton step (one pass each).
    """

    def __init__(self, l1: float = 0.0, l2: float = 0.0, logistic: bool = False, rounds: int = 20) -> None:
        self.l1, self.l2, self.logistic, self.rounds = l1, l2, logistic, rounds

    def _solve(self, xx: np.ndarray, xy: np.ndarray, n: float, w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for _ in range(1000):
            before = w.copy()
            for j in range(len(w)):
                r = (xy[j] - xx[j] @ w + xx[j, j] * w[j]) / n
                a = xx[j, j] / n
                if j == len(w) - 1:
                    w[j] = r / max(a, 1e-300)
                else:
                    w[j] = math.copysign(max(abs(r) - self.l1, 0), r) / max(a + self.l2, 1e-300)
            if np.abs(w - before).max() <= 1e-10 * (1 + np.abs(w).max()):
                break
        return w

    def fit(self, df: DataFrame) -> Model:
        d = dimensions(df)
        if not self.logistic:
            xx, xy, _ = normal_equations(df, d)
            w = self._solve(xx, xy, xx[-1, -1], np.zeros(d + 1))
            self.weights = w
            return ArrayModel(lambda x: x @ w[:-1] + w[-1])
        w = np.zeros(d + 1)
        for _ in range(self.rounds):
            now = w

            def f(x: np.ndarray, y: np.ndarray, weight: np.ndarray, now: np.ndarray = now) -> np.ndarray:
                z = np.hstack((x, np.ones((len(x), 1))))
                eta = np.clip(z @ now, -30, 30)
                p = 1 / (1 + np.exp(-eta))
                v = np.maximum(p * (1 - p), 1e-5) * weight
                t = eta + (y - p) * weight / v
                return np.concatenate((((z * v[:, None]).T @ z).ravel(), (z * v[:, None]).T @ t, [weight.sum()]))

            m = array_sum(df, f, (d + 1) ** 2 + d + 2)
            w = self._solve(m[: (d + 1) ** 2].reshape(d + 1, d + 1), m[(d + 1) ** 2 : -1], m[-1], w)
            if np.abs(w - now).max() <= 1e-8 * (1 + np.abs(w).max()):
                break
        self.weights = w
        return ArrayModel(lambda x: np.stack((1 / (1 + np.exp(np.clip(x @ w[:-1] + w[-1], -500, 500))), 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))), axis=1), classes=2)


class SoftmaxRegression(Learner):
    """Multinomial logistic regression by accelerated full-batch steps; ``prior`` gaussian, laplace, elastic, cauchy or uniform."""

    def __init__(self, penalty: float = 1e-4, prior: str = "gaussian", rounds: int = 60, rate: float = 1.0) -> None:
        self.penalty, self.prior, self.rounds, self.rate = penalty, prior, rounds, rate

    def fit(self, df: DataFrame) -> Model:
        d, k = dimensions(df), class_count(df)
        top = array_sum(df, lambda x, y, w: np.array([(w * ((x * x).sum(axis=1) + 1)).sum(), w.sum()]), 2)
        step = self.rate * 2 / max(top[0] / max(top[1], 1e-300), 1e-12)
        b = v = np.zeros((d + 1, k))
        t = 1.0
        for _ in range(self.rounds):
            at = v

            def f(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray = at) -> np.ndarray:
                z = np.hstack((x, np.ones((len(x), 1))))
                s = z @ at
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y.astype(int)] -= 1
                return z.T @ (p * w[:, None])

            g = array_sum(df, f, (d + 1) * k).reshape(d + 1, k) / max(top[1], 1e-300)
            if self.prior in ("gaussian", "elastic"):
                g[:-1] += self.penalty * at[:-1]
            elif self.prior == "cauchy":
                g[:-1] += self.penalty * 2 * at[:-1] / (1 + at[:-1] ** 2)
            new = at - step * g
            if self.prior in ("laplace", "elastic"):
                new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * self.penalty, 0)
            nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
            v, b, t = new + (t - 1) / nt * (new - b), new, nt
        self.weights = b

        def scores(x: np.ndarray) -> np.ndarray:
            s = x @ b[:-1] + b[-1]
            return np.exp(s - s.max(axis=1, keepdims=True))

        return ArrayModel(scores, classes=k)


class AveragedLogistic(Learner):
    """One-pass averaging: each worker fits its own logistic regression, then one on their scores weighs them (OWA)."""

    def __init__(self, workers: int = 8, l2: float = 1e-3, key: str = "id") -> None:
        self.workers, self.l2, self.key = workers, l2, key

    def fit(self, df: DataFrame) -> Model:
        d, l2, n = dimensions(df), self.l2, self.workers
        rows = df.select(fold_of(F.col(self.key), n).alias("part"), "features", F.col("label").cast("double").alias("label")).repartition(n, "part")

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            for b in batches:
                for part, some in b.groupby("part"):
                    held.setdefault(part, []).append((np.stack(some["features"]).astype(float), some["label"].to_numpy()))
            for part, parts in held.items():
                x = np.hstack((np.concatenate([p[0] for p in parts]), np.ones((sum(len(p[1]) for p in parts), 1))))
                y, w = np.concatenate([p[1] for p in parts]), np.zeros(d + 1)
                for _ in range(25):
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    v = np.maximum(p * (1 - p), 1e-5)
                    w = w + np.linalg.solve((x * v[:, None]).T @ x / len(y) + l2 * np.eye(d + 1), x.T @ (y - p) / len(y) - l2 * w)
                yield pd.DataFrame({"part": [part], "w": [w], "n": [len(y)]})

        got = sorted(rows.mapInPandas(task, "part int, w array<double>, n long").collect())  # one row a worker
        ws = np.array([r.w for r in got])
        second = CoordinateDescent(l2=1e-3, logistic=True)

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            z = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, d))
            return pd.Series(list(z @ ws[:, :-1].T + ws[:, -1]))

        second.fit(df.select(scores("features").alias("features"), "label"))
        mix = second.weights
        w = np.append(ws[:, :-1].T @ mix[:-1], ws[:, -1] @ mix[:-1] + mix[-1])
        self.weights = w
        return ArrayModel(lambda x: np.stack((1 / (1 + np.exp(np.clip(x @ w[:-1] + w[-1], -500, 500))), 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))), axis=1), classes=2)


class Ransac(Learner):
    """A regressor fitted to the rows that agree with the best of many fits to small seeded samples."""

    def __init__(self, learner: Learner, rounds: int = 10, sample: int = 20, tolerance: float = 1.0, key: str = "id", seed: int = 0) -> None:
        self.learner, self.rounds, self.sample, self.tolerance, self.key, self.seed = learner, rounds, sample, tolerance, key, seed

    def fit(self, df: DataFrame) -> Model:
        best = (-1, None)
        agrees = F.abs(F.col("prediction") - F.col("label")) <= self.tolerance
        for i in range(self.rounds):
            some = df.orderBy(F.xxhash64(self.key, F.lit(self.seed), F.lit(i))).limit(self.sample)
            model = self.learner.fit(some)
            n = model.transform(df).where(agrees).count()
            if n > best[0]:
                best = (n, model)
        self.agreeing = best[0]
        return self.learner.fit(best[1].transform(df).where(agrees).select(df.columns))


class Rocchio(Learner):
    """The nearest class mean."""

    def fit(self, df: DataFrame) -> Model:
        k, d = class_count(df), dimensions(df)

        def f(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = np.zeros((k, d + 1))
            np.add.at(out, y.astype(int), np.hstack((x, np.ones((len(x), 1)))) * w[:, None])
            return out

        s = array_sum(df, f, k * (d + 1)).reshape(k, d + 1)
        means = s[:, :-1] / np.maximum(s[:, -1:], 1e-300)

        def scores(x: np.ndarray) -> np.ndarray:
            dist = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (means * means).sum(1)[None, :] - 2 * x @ means.T, 0))
            return 1 / (dist + 1e-12)

        return ArrayModel(scores, classes=k)
