"""Kernel methods on a bounded set of landmarks (Nystrom), random features, and local models over neighbours.

Landmarks are a documented, bounded sample; every row is then mapped and used,
so fits are one pass and models are small.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ArrayModel, Learner, Ml, Model, class_count, dimensions
from statloom.models.linear import Ridge, array_sum
from statloom.models.online import Expansion, linear_kernel, rbf  # noqa: F401  kernels and expansions for callers

#: Landmarks by default and at most.
LANDMARKS, MOST_LANDMARKS = 128, 4096

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def polynomial(degree: float = 2.0, alpha: float = 1.0, c: float = 1.0) -> Kernel:
    return lambda a, b: (alpha * a @ b.T + c) ** degree


def landmarks(df: DataFrame, n: int = LANDMARKS, method: str = "uniform", seed: int = 0, key: str = "id") -> np.ndarray:
    """``n`` feature vectors (at most MOST_LANDMARKS): uniform by hash, by their norm, or means of k-means over a sample."""
    n = min(n, MOST_LANDMARKS)
    order = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    if method == "norm":
        norm = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
        order = F.log(1 - order) / -F.greatest(norm, F.lit(1e-12))  # exponential clocks: chances as the squared norms
    take = n if method != "kmeans" else min(8 * n, MOST_LANDMARKS)
    x = np.array([r.features for r in df.select("features", order.alias("o")).orderBy("o").limit(take).collect()], dtype=float)
    if method != "kmeans" or len(x) <= n:
        return x
    c = x[:n].copy()
    for _ in range(10):
        near = ((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(axis=1)
        for i in range(n):
            if (near == i).any():
                c[i] = x[near == i].mean(axis=0)
    return c


def mapped(df: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with ``features`` replaced by a NumPy function of them."""

    @F.pandas_udf("array<double>")
    def to(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(f(np.stack(x.to_numpy()).astype(float))))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn("features", to("features"))


def nystrom_map(points: np.ndarray, kernel: Kernel, ridge: float = 1e-8) -> Callable[[np.ndarray], np.ndarray]:
    """Features whose inner products are the kernel's on the landmarks, and near it elsewhere."""
    values, vectors = np.linalg.eigh(kernel(points, points) + ridge * np.eye(len(points)))
    keep = values > 1e-10 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    return lambda x: kernel(x, points) @ root


def random_fourier_map(d: int, n: int = 256, sigma: float = 1.0, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Random features of the Gaussian kernel."""
    rnd = np.random.default_rng(seed)
    w, b = rnd.normal(0, 1 / sigma, (d, n)), rnd.uniform(0, 2 * math.pi, n)
    return lambda x: math.sqrt(2 / n) * np.cos(x @ w + b)


class _Mapped(Model):
    def __init__(self, model: Model, f: Callable[[np.ndarray], np.ndarray]) -> None:
        self.model, self.f = model, f

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(mapped(df.withColumn("__own", F.col("features")), self.f))
        return out.drop("features").withColumnRenamed("__own", "features")


class OnFeatures(Learner):
    """Any learner on the features of a kernel's landmarks or of a given map."""

    def __init__(self, learner: Learner, kernel: Kernel | None = None, points: int = LANDMARKS, method: str = "uniform", map_: Callable | None = None, seed: int = 0, key: str = "id") -> None:
        self.learner, self.kernel, self.points, self.method, self.map, self.seed, self.key = learner, kernel, points, method, map_, seed, key

    def fit(self, df: DataFrame) -> Model:
        f = self.map or nystrom_map(landmarks(df, self.points, self.method, self.seed, self.key), self.kernel)
        return _Mapped(self.learner.fit(mapped(df, f)), f)


def kernel_ridge(kernel: Kernel, penalty: float = 1e-3, points: int = LANDMARKS, **more) -> Learner:
    """Kernel ridge regression on landmarks; also the batch solution of recursive kernel least squares."""
    return OnFeatures(Ridge(penalty), kernel, points, **more)


class _Sign(Learner):
    def __init__(self, learner: Learner) -> None:
        self.learner = learner

    def fit(self, df: DataFrame) -> Model:
        from statloom.models.ensemble import RegressorToClassifier

        return RegressorToClassifier(self.learner).fit(df)


def least_squares_svm(kernel: Kernel, c: float = 1.0, points: int = LANDMARKS, **more) -> Learner:
    """Least-squares support vector machine of two classes: ridge regression on -1 and 1."""
    return _Sign(OnFeatures(Ridge(1 / c, penalise_intercept=False), kernel, points, **more))


def kernel_svm(kernel: Kernel, c: float = 1.0, points: int = LANDMARKS, bias: bool = True, rounds: int = 100, **more) -> Learner:
    """Soft-margin kernel machine of two classes, solved on landmark features."""
    return OnFeatures(Ml(C.LinearSVC, regParam=1e-3 / c, maxIter=rounds, fitIntercept=bias, standardization=False), kernel, points, **more)


class DivideAndConquerSvm(Learner):
    """Rows are dealt to the nearest of a few centres, and each centre has its own kernel machine."""

    def __init__(self, kernel: Kernel, parts: int = 4, c: float = 1.0, points: int = 64, key: str = "id") -> None:
        self.kernel, self.parts, self.c, self.points, self.key = kernel, parts, c, points, key

    def fit(self, df: DataFrame) -> Model:
        centres = landmarks(df, self.parts, "kmeans", key=self.key)
        place = lambda x: ((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        dealt = ArrayModel(place).transform(df).withColumnRenamed("prediction", "__part")
        from statloom.models.ensemble import PriorClassifier

        models = []
        for i in range(len(centres)):
            mine = dealt.where(F.col("__part") == i).drop("__part")
            both = mine.select("label").distinct().count() > 1
            models.append((kernel_svm(self.kernel, self.c, self.points, key=self.key) if both else PriorClassifier()).fit(mine))
        return _Dealt(ArrayModel(place), models)


class _Dealt(Model):
    def __init__(self, place: Model, models: list[Model]) -> None:
        self.place, self.models = place, models

    def transform(self, df: DataFrame) -> DataFrame:
        dealt = self.place.transform(df.drop("prediction", "probability")).withColumnRenamed("prediction", "__part")
        out = None
        for i, m in enumerate(self.models):
            one = m.transform(dealt.where(F.col("__part") == i)).select(*df.columns, "prediction")
            out = one if out is None else out.unionByName(one)
        return out


class Kriging(Learner):
    """Ordinary kriging with a power variogram on landmarks: distances to them, with weights that add up to one."""

    def __init__(self, power: float = 1.5, points: int = LANDMARKS, error: float = 1e-6, key: str = "id") -> None:
        self.power, self.points, self.error, self.key = power, points, error, key

    def fit(self, df: DataFrame) -> Model:
        points = landmarks(df, self.points, key=self.key)
        dist = lambda x: np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * x @ points.T, 0))
        p, n = self.power, len(points)

        def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:  # least squares of the values on the landmarks' variogram
            z = np.hstack((dist(x) ** p, np.ones((len(x), 1))))
            return np.concatenate(((z.T @ z).ravel(), z.T @ y))

        m = array_sum(df, sums, (n + 1) ** 2 + n + 1)
        a = m[: (n + 1) ** 2].reshape(n + 1, n + 1) + self.error * np.eye(n + 1)
        weights = np.linalg.lstsq(a, m[(n + 1) ** 2 :], rcond=None)[0]
        return ArrayModel(lambda x: dist(x) ** p @ weights[:-1] + weights[-1])


def kernel_regression(train: DataFrame, queries: DataFrame, kernel: Kernel, block: int = 2048) -> DataFrame:
    """``id, prediction`` of each query: the kernel-weighted mean of all labels (Nadaraya-Watson).

    Every block of queries meets every block of the training rows once and
    yields one partial sum a query; a query without weight has null.
    """
    blocks = lambda df: max(1, -(-df.count() // block))
    nt, nq = blocks(train), blocks(queries)
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = train.select("id", "features", F.col("label").cast("double").alias("y"), at(nt).alias("a"), F.lit(0).alias("side")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = queries.select("id", "features", F.lit(0.0).alias("y"), at(nq).alias("b"), F.lit(1).alias("side")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(nt - 1))))
    rows = left.unionByName(right.select(left.columns)).repartition("a", "b").sortWithinPartitions("a", "b", "side", "id")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, xs, ys = None, [], []
        for batch in batches:
            for (a, b, side), some in batch.groupby(["a", "b", "side"], sort=True):
                if (a, b) != here:
                    here, xs, ys = (a, b), [], []
                x = np.stack(some["features"]).astype(float)
                if side == 0:
                    xs.append(x)
                    ys.append(some["y"].to_numpy())
                elif xs:
                    k = kernel(x, np.concatenate(xs))
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "w": k.sum(axis=1), "s": k @ np.concatenate(ys)})

    parts = rows.mapInPandas(task, "id long, w double, s double")
    sums = parts.groupBy("id").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    return sums.select("id", F.when(F.col("w") > 0, F.col("s") / F.col("w")).alias("prediction"))


def local_regression(train: DataFrame, queries: DataFrame, k: int = 30, ridge: float = 1e-6) -> DataFrame:
    """``id, prediction``: a weighted linear fit over each query's ``k`` nearest rows (LWL)."""
    from statloom.operators.neighbors import nearest

    near = nearest(queries, train, k)

    def fit(some: pd.DataFrame) -> pd.DataFrame:
        x, y, d = np.stack(some["vec"]).astype(float), some["label"].to_numpy(float), some["distance"].to_numpy()
        w = np.exp(-((d / max(d.max(), 1e-12)) ** 2) * 2)
        q = np.asarray(some["query"].iloc[0], dtype=float)
        z = np.hstack((x - q, np.ones((len(x), 1))))
        b = np.linalg.solve((z * w[:, None]).T @ z + ridge * np.eye(z.shape[1]), (z * w[:, None]).T @ y)
        return pd.DataFrame({"id": [some["q"].iloc[0]], "prediction": [b[-1]]})

    rows = near.join(train.select(F.col("id").alias("v"), F.col("features").alias("vec"), "label"), "v").join(queries.select(F.col("id").alias("q"), F.col("features").alias("query")), "q")
    return rows.groupBy("q").applyInPandas(fit, "id long, prediction double")


def discriminant_neighbours(train: DataFrame, queries: DataFrame, k: int = 5, around: int = 50, eps: float = 1.0) -> DataFrame:
    """``id, prediction``: the vote of the ``k`` nearest under a metric bent by the classes around the query (DANN)."""
    from statloom.operators.neighbors import nearest

    near = nearest(queries, train, around)

    def vote(some: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(some["vec"]).astype(float), some["label"].to_numpy()
        q = np.asarray(some["query"].iloc[0], dtype=float)
        mean, within, between = x.mean(axis=0), np.zeros((x.shape[1],) * 2), np.zeros((x.shape[1],) * 2)
        for c in np.unique(y):
            mine = x[y == c]
            m = mine.mean(axis=0)
            within += (mine - m).T @ (mine - m) / len(x)
            between += len(mine) / len(x) * np.outer(m - mean, m - mean)
        values, vectors = np.linalg.eigh(within + 1e-6 * np.eye(len(within)))
        root = vectors / np.sqrt(values) @ vectors.T
        metric = root @ (root @ between @ root + eps * np.eye(len(within))) @ root
        d = np.einsum("ij,jk,ik->i", x - q, metric, x - q)
        best = y[np.argsort(d, kind="stable")[:k]]
        kinds, n = np.unique(best, return_counts=True)
        return pd.DataFrame({"id": [some["q"].iloc[0]], "prediction": [float(kinds[n.argmax()])]})

    rows = near.join(train.select(F.col("id").alias("v"), F.col("features").alias("vec"), "label"), "v").join(queries.select(F.col("id").alias("q"), F.col("features").alias("query")), "q")
    return rows.groupBy("q").applyInPandas(vote, "id long, prediction double")


class RbfNetwork(Learner):
    """Gaussian units at landmarks (random or k-means), widths by the distance to other centres, and a linear layer."""

    def __init__(self, top: Learner, units: int = 64, method: str = "kmeans", width: str = "others", alpha: float = 1.0, key: str = "id") -> None:
        self.top, self.units, self.method, self.width, self.alpha, self.key = top, units, method, width, alpha, key

    def fit(self, df: DataFrame) -> Model:
        c = landmarks(df, self.units, self.method, key=self.key)
        d = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * c @ c.T, 0))
        np.fill_diagonal(d, np.inf if self.width == "nearest" else np.nan)
        s = np.maximum(self.alpha * (d.min(axis=1) if self.width == "nearest" else np.nanmean(d, axis=1)), 1e-9)
        f = lambda x: np.exp(-np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0) / (2 * s * s))
        return _Mapped(self.top.fit(mapped(df, f)), f)


class VectorQuantisation(Learner):
    """Learning vector quantisation: prototypes of each class move in batches towards right rows and away from wrong ones.

    ``version`` "1" moves the nearest prototype, "2" and "2.1" also the second
    if exactly one of both is right and the row lies in a window between them,
    "3" moves both, gently, when both are right.
    """

    def __init__(self, prototypes: int = 3, epochs: int = 10, rate: float = 0.3, window: float = 0.3, version: str = "1", key: str = "id") -> None:
        self.prototypes, self.epochs, self.rate, self.window, self.version, self.key = prototypes, epochs, rate, window, version, key

    def fit(self, df: DataFrame) -> Model:
        k, d = class_count(df), dimensions(df)
        parts = [landmarks(df.where(F.col("label") == c), self.prototypes, "kmeans", key=self.key) for c in range(k)]
        proto = np.concatenate([p for p in parts if len(p)])
        kinds = np.concatenate([np.full(len(p), i) for i, p in enumerate(parts)])
        for e in range(self.epochs):
            now, rate, version, window = proto, self.rate * (1 - e / self.epochs), self.version, self.window

            def f(x: np.ndarray, y: np.ndarray, w: np.ndarray, now: np.ndarray = now, version: str = version, window: float = window) -> np.ndarray:
                out = np.zeros((len(now), d + 1))
                dist = np.maximum((x * x).sum(1)[:, None] + (now * now).sum(1)[None, :] - 2 * x @ now.T, 0)
                order = np.argsort(dist, axis=1)[:, :2]
                first, second = order[:, 0], order[:, -1]
                right1, right2 = kinds[first] == y, kinds[second] == y
                rows = np.arange(len(x))
                near = np.sqrt(dist[rows, first] / np.maximum(dist[rows, second], 1e-300)) > (1 - window) / (1 + window)
                for at, sign in ((first, np.where(right1, 1.0, -1.0)), (second, np.where(right2, 1.0, -1.0))):
                    if version == "1":
                        use = np.ones(len(x), dtype=bool) if at is first else np.zeros(len(x), dtype=bool)
                    else:
                        use = near & (right1 != right2)
                        if version == "2":
                            use &= ~right1
                    if version == "3":
                        both = right1 & right2
                        sign = np.where(both, 0.2, sign)
                        use |= both
                    np.add.at(out, at[use], np.hstack((x[use] - now[at[use]], np.ones((int(use.sum()), 1)))) * (sign * w)[use][:, None] * np.array([1.0] * d + [0.0]))
                    np.add.at(out[:, -1], at[use], w[use])
                return out

            s = array_sum(df, f, len(proto) * (d + 1)).reshape(len(proto), d + 1)
            proto = now + rate * s[:, :-1] / np.maximum(s[:, -1:], 1.0)
        self.codebook, self.kinds = proto, kinds

        def scores(x: np.ndarray) -> np.ndarray:
            dist = np.maximum((x * x).sum(1)[:, None] + (proto * proto).sum(1)[None, :] - 2 * x @ proto.T, 0)
            best = np.stack([dist[:, kinds == c].min(axis=1) if (kinds == c).any() else np.full(len(x), np.inf) for c in range(k)], axis=1)
            return 1 / (1e-12 + best)

        return ArrayModel(scores, classes=k)


class SelfOrganisingMap(Learner):
    """A grid of prototypes fitted by batch steps whose neighbourhood shrinks; cells vote with the classes they hold."""

    def __init__(self, rows: int = 6, columns: int = 6, epochs: int = 15, width: float = 3.0, key: str = "id") -> None:
        self.rows, self.columns, self.epochs, self.width, self.key = rows, columns, epochs, width, key

    def fit(self, df: DataFrame) -> Model:
        k, d, n = class_count(df), dimensions(df), self.rows * self.columns
        at = np.stack(np.unravel_index(np.arange(n), (self.rows, self.columns)), axis=1)
        grid = ((at[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)
        start = landmarks(df, n, key=self.key)
        proto = start[np.arange(n) % len(start)]

        def sums(now: np.ndarray) -> np.ndarray:
            def f(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
                near = ((x * x).sum(1)[:, None] + (now * now).sum(1)[None, :] - 2 * x @ now.T).argmin(axis=1)
                out = np.zeros((n, d + 1 + k))
                one = np.zeros((len(x), k))
                one[np.arange(len(x)), y.astype(int)] = 1
                np.add.at(out, near, np.hstack((x, np.ones((len(x), 1)), one)) * w[:, None])
                return out

            return array_sum(df, f, n * (d + 1 + k)).reshape(n, d + 1 + k)

        for e in range(self.epochs):
            s = sums(proto)
            h = np.exp(-grid / (2 * (self.width * (0.1 / self.width) ** (e / max(self.epochs - 1, 1)) + 1e-9) ** 2))
            total = h @ s[:, d : d + 1]
            proto = np.where(total > 1e-9, h @ s[:, :d] / np.maximum(total, 1e-300), proto)
        s = sums(proto)
        counts = np.exp(-grid / 0.5) @ s[:, d + 1 :] + 1e-9
        self.codebook = proto

        def scores(x: np.ndarray) -> np.ndarray:
            near = ((x * x).sum(1)[:, None] + (proto * proto).sum(1)[None, :] - 2 * x @ proto.T).argmin(axis=1)
            return counts[near]

        return ArrayModel(scores, classes=k)




class LocalQuantisation(Learner):
    """Prototypes of learning vector quantisation, each with a local learner for the rows nearest to it (LVQLLC)."""

    def __init__(self, local: Learner, prototypes: int = 2, key: str = "id", **more) -> None:
        self.local, self.vq = local, VectorQuantisation(prototypes, key=key, **more)

    def fit(self, df: DataFrame) -> Model:
        from statloom.models.ensemble import PriorClassifier

        self.vq.fit(df)
        book = self.vq.codebook
        place = ArrayModel(lambda x: ((x * x).sum(1)[:, None] + (book * book).sum(1)[None, :] - 2 * x @ book.T).argmin(axis=1))
        dealt = place.transform(df).withColumnRenamed("prediction", "__part")
        kinds = {r["__part"]: r.k for r in dealt.groupBy("__part").agg(F.count_distinct("label").alias("k")).collect()}  # a row a prototype
        models = []
        for i in range(len(book)):
            mine = dealt.where(F.col("__part") == i).drop("__part") if i in kinds else df
            models.append((self.local if kinds.get(i, 1) > 1 else PriorClassifier()).fit(mine))
        return _Dealt(place, models)
