"""Fitted transforms of the ``features`` array, and feature selection around any learner."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import Learner, accuracy, cross_validate, dimensions, rmse
from statloom.models.kernels import landmarks, mapped
from statloom.models.linear import array_sum
from statloom.plans.lineage import cut


class Transform:
    """A NumPy function of the features that is fitted to a table; some have an inverse."""

    def fit(self, df: DataFrame) -> Transform:
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def inverse(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError("this transform has no inverse")

    def transform(self, df: DataFrame) -> DataFrame:
        return mapped(df, self.apply)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return mapped(df, self.inverse)


class Chain(Transform):
    """Transforms one after the other, each fitted to what the earlier ones make."""

    def __init__(self, steps: Sequence[Transform]) -> None:
        self.steps = list(steps)

    def fit(self, df: DataFrame) -> Transform:
        for s in self.steps:
            df = s.fit(df).transform(df)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        for s in self.steps:
            x = s.apply(x)
        return x

    def inverse(self, x: np.ndarray) -> np.ndarray:
        for s in reversed(self.steps):
            x = s.inverse(x)
        return x


class InverseOf(Transform):
    """The inverse of a fitted transform as a transform."""

    def __init__(self, of: Transform) -> None:
        self.of = of

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.of.inverse(x)

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self.of.apply(x)


class Piped(Learner):
    """A transform and a learner as one learner."""

    def __init__(self, transform: Transform, learner: Learner) -> None:
        self.steps, self.learner = transform, learner

    def fit(self, df: DataFrame):
        from statloom.models.kernels import _Mapped

        steps = self.steps.fit(df)
        return _Mapped(self.learner.fit(steps.transform(df)), steps.apply)


#: Features, at most, whose moments are sums of columns, which need no Python worker.
COLUMNS = 16


def _moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, covariance and count, by sums around the first row so that large means lose nothing."""
    d = dimensions(df)
    row = df.select("features").first()
    at = np.array(row.features, dtype=float) if row else np.zeros(d)
    if d <= COLUMNS:
        z = [F.coalesce(F.get("features", F.lit(i)), F.lit(float("nan"))) - float(at[i]) for i in range(d)]
        off = df.select(*[c.cast("double").alias(f"z{i}") for i, c in enumerate(z)], F.lit(1.0).alias(f"z{d}"))
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        got = off.agg(*[F.coalesce(F.sum(F.col(f"z{i}") * F.col(f"z{j}")), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).first()
        m = np.zeros((d + 1, d + 1))
        for (i, j), v in zip(pairs, got):
            m[i, j] = m[j, i] = v
        return _centred(m, at)
    labelled = df if "label" in df.columns else df.withColumn("label", F.lit(0.0))

    def f(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = np.hstack((x - at, np.ones((len(x), 1))))
        return z.T @ z

    return _centred(array_sum(labelled.select("features", "label"), f, (d + 1) ** 2).reshape(d + 1, d + 1), at)


def _centred(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, covariance and count by the sums ``m`` of products of deviations from ``at`` and a last one."""
    n = max(m[-1, -1], 1.0)
    mean = m[-1, :-1] / n
    return at + mean, m[:-1, :-1] / n - np.outer(mean, mean), n


class Center(Transform):
    def fit(self, df: DataFrame) -> Transform:
        self.mean = _moments(df)[0]
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x - self.mean

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return x + self.mean


class Standard(Transform):
    def fit(self, df: DataFrame) -> Transform:
        self.mean, cov, _ = _moments(df)
        self.sd = np.sqrt(np.diag(cov) + 1e-10)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return x * self.sd + self.mean


class PNorm(Transform):
    """Rows divided by their p-norm; zero rows stay."""

    def __init__(self, p: float = 2.0) -> None:
        self.p = p

    def apply(self, x: np.ndarray) -> np.ndarray:
        n = (np.abs(x) ** self.p).sum(axis=1, keepdims=True) ** (1 / self.p)
        return x / np.where(n > 0, n, 1)


class Pca(Transform):
    """Principal directions; ``whiten`` scales them to unit variance, ``zca`` turns them back to the old axes."""

    def __init__(self, k: int | None = None, whiten: bool = False, zca: bool = False, ridge: float = 0.0, center: bool = True) -> None:
        self.k, self.whiten, self.zca, self.ridge, self.center = k, whiten or zca, zca, ridge, center

    def fit(self, df: DataFrame) -> Transform:
        mean, cov, _ = _moments(df)
        self.mean = mean if self.center else np.zeros_like(mean)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][: self.k or len(values)]
        self.values = np.maximum(values[order], 0)
        vectors = vectors[:, order]
        self.vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        scale = 1 / np.sqrt(self.values + self.ridge + 1e-12) if self.whiten else np.ones(len(order))
        self.matrix = self.vectors * scale
        self.back = (self.vectors / scale).T
        if self.zca:
            self.matrix, self.back = self.matrix @ self.vectors.T, self.vectors @ self.back
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return x @ self.back + self.mean


class TruncatedSvd(Transform):
    """The largest singular directions, without centring."""

    def __init__(self, k: int) -> None:
        self.k = k

    def fit(self, df: DataFrame) -> Transform:
        mean, cov, n = _moments(df)
        values, vectors = np.linalg.eigh(n * (cov + np.outer(mean, mean)))
        order = np.argsort(values)[::-1][: self.k]
        self.singular, self.vectors = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.vectors

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return x @ self.vectors.T


def lanczos(df: DataFrame, k: int, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and vectors of ``X'X`` by Lanczos steps; each multiplies by the rows in one pass, so no square matrix is summed up."""
    d = dimensions(df)
    rows = cut(df.select("features", F.lit(0.0).alias("label")))
    q = np.random.default_rng(seed).normal(size=d)
    basis, a, b = [q / np.linalg.norm(q)], [], []
    for _ in range(min(rounds, d)):
        now = basis[-1]
        w = array_sum(rows, lambda x, y, _, now=now: x.T @ (x @ now), d)
        a.append(float(w @ now))
        for v in basis:  # full reorthogonalisation keeps the basis true
            w = w - (w @ v) * v
        for v in basis:
            w = w - (w @ v) * v
        n = float(np.linalg.norm(w))
        if n < 1e-10 * max(abs(x) for x in a) or len(basis) == d:
            break
        b.append(n)
        basis.append(w / n)
    m = len(a)
    t = np.diag(a) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1)
    values, vectors = np.linalg.eigh(t)
    order = np.argsort(values)[::-1][:k]
    return values[order], np.array(basis[:m]).T @ vectors[:, order]


class RandomProjection(Transform):
    """Johnson-Lindenstrauss projections: gauss, binary, sparse, sparse_sqrt or sparse_log entries."""

    def __init__(self, k: int, mode: str = "gauss", seed: int = 0) -> None:
        self.k, self.mode, self.seed = k, mode, seed

    def fit(self, df: DataFrame) -> Transform:
        d, rnd = dimensions(df), np.random.default_rng(self.seed)
        if self.mode == "gauss":
            m = rnd.normal(size=(d, self.k))
        else:
            s = {"binary": 1.0, "sparse": 3.0, "sparse_sqrt": math.sqrt(d), "sparse_log": d / max(math.log(d), 1.0)}[self.mode]
            u = rnd.uniform(size=(d, self.k))
            m = math.sqrt(s) * np.where(u < 1 / (2 * s), 1.0, np.where(u < 1 / s, -1.0, 0.0))
        self.matrix = m / math.sqrt(self.k)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix


class FastIca(Transform):
    """Independent components of whitened features by fixed-point steps, one pass each; ``contrast`` log_cosh, exp or kurtosis."""

    def __init__(self, k: int, contrast: str = "log_cosh", rounds: int = 50, seed: int = 0) -> None:
        self.k, self.contrast, self.rounds, self.seed = k, contrast, rounds, seed

    def fit(self, df: DataFrame) -> Transform:
        self.white = Pca(self.k, whiten=True).fit(df)
        z = cut(self.white.transform(df.select("features", F.lit(0.0).alias("label"))))
        k, contrast = self.white.matrix.shape[1], self.contrast
        w = np.linalg.qr(np.random.default_rng(self.seed).normal(size=(k, k)))[0]
        for _ in range(self.rounds):
            now = w

            def f(x: np.ndarray, y: np.ndarray, _: np.ndarray, now: np.ndarray = now) -> np.ndarray:
                s = x @ now.T
                if contrast == "exp":
                    e = np.exp(-s * s / 2)
                    g, dg = s * e, (1 - s * s) * e
                elif contrast == "kurtosis":
                    g, dg = s**3, 3 * s * s
                else:
                    g = np.tanh(s)
                    dg = 1 - g * g
                return np.concatenate(((g.T @ x).ravel(), dg.sum(axis=0), [len(x)]))

            m = array_sum(z, f, k * k + k + 1)
            new = m[: k * k].reshape(k, k) / m[-1] - (m[k * k : -1] / m[-1])[:, None] * w
            u, _, v = np.linalg.svd(new)
            w = u @ v
            if np.abs(np.abs((w * now).sum(axis=1)) - 1).max() < 1e-6:
                break
        self.unmix = w
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.white.apply(x) @ self.unmix.T

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self.white.inverse(x @ self.unmix)


class KernelPca(Transform):
    """Principal directions in a kernel's space, on a bounded set of landmarks."""

    def __init__(self, kernel, k: int = 2, points: int = 128, key: str = "id", seed: int = 0) -> None:
        self.kernel, self.k, self.points, self.key, self.seed = kernel, k, points, key, seed

    def fit(self, df: DataFrame) -> Transform:
        self.at = landmarks(df, self.points, seed=self.seed, key=self.key)
        g = self.kernel(self.at, self.at)
        self.row, self.all = g.mean(axis=0), g.mean()
        values, vectors = np.linalg.eigh(g - self.row[None, :] - self.row[:, None] + self.all)
        order = np.argsort(values)[::-1][: self.k]
        self.alpha = vectors[:, order] / np.sqrt(np.maximum(values[order], 1e-12))
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        g = self.kernel(x, self.at)
        return (g - g.mean(axis=1, keepdims=True) - self.row[None, :] + self.all) @ self.alpha


class KernelFeatures(Transform):
    """Nystrom features on landmarks (``points``), or random Fourier features of the Gaussian kernel (``sigma``)."""

    def __init__(self, kernel=None, points: int = 128, sigma: float | None = None, method: str = "uniform", key: str = "id", seed: int = 0) -> None:
        self.kernel, self.points, self.sigma, self.method, self.key, self.seed = kernel, points, sigma, method, key, seed

    def fit(self, df: DataFrame) -> Transform:
        from statloom.models.kernels import nystrom_map, random_fourier_map

        self.map = random_fourier_map(dimensions(df), self.points, self.sigma, self.seed) if self.sigma else nystrom_map(landmarks(df, self.points, self.method, self.seed, self.key), self.kernel)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.map(x)


class AutoDeskew(Transform):
    """Each feature by the one of x, log, root or signed square that leaves least skewness, chosen in one pass."""

    NAMES = ("none", "log", "root", "square")

    @staticmethod
    def _all(x: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
        y = x - low
        return [x, np.log1p(np.maximum(y, 0)), np.sqrt(np.maximum(y, 0)), np.sign(x) * x * x]

    def fit(self, df: DataFrame) -> Transform:
        d = dimensions(df)
        row = df.agg(*[F.min(F.element_at("features", i + 1)) for i in range(d)]).first()
        self.low = np.minimum(np.array([v if v is not None else 0.0 for v in row]), 0)
        low, make = self.low, self._all

        def f(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = [np.stack([v.sum(axis=0), (v**2).sum(axis=0), (v**3).sum(axis=0)]) for v in make(x, low)]
            return np.append(np.stack(out).ravel(), len(x))

        m = array_sum(df.withColumn("label", F.lit(0.0)), f, 12 * d + 1)
        n, s = max(m[-1], 1), m[:-1].reshape(4, 3, d)
        mu = s[:, 0] / n
        var = np.maximum(s[:, 1] / n - mu**2, 1e-300)
        skew = (s[:, 2] / n - 3 * mu * s[:, 1] / n + 2 * mu**3) / var**1.5
        self.chosen = np.abs(np.where(np.isfinite(skew), skew, np.inf)).argmin(axis=0)
        return self

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.stack(self._all(x, self.low))[self.chosen, :, np.arange(x.shape[1])].T


class Remove(Transform):
    """Leaves out features by position."""

    def __init__(self, gone: Sequence[int]) -> None:
        self.gone = sorted(set(gone))

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.delete(x, self.gone, axis=1)


class Keep(Transform):
    def __init__(self, kept: Sequence[int]) -> None:
        self.kept = list(kept)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.kept]


class Polynomial(Transform):
    """All products of at most ``degree`` features, with a leading one if ``constant``."""

    def __init__(self, degree: int = 2, constant: bool = False) -> None:
        self.degree, self.constant = degree, constant

    def apply(self, x: np.ndarray) -> np.ndarray:
        import itertools

        out = [np.ones(len(x))] if self.constant else []
        for k in range(1, self.degree + 1):
            out += [np.prod(x[:, list(c)], axis=1) for c in itertools.combinations_with_replacement(range(x.shape[1]), k)]
        return np.stack(out, axis=1)


def insert_missing(df: DataFrame, share: float, key: str = "id", seed: int = 0) -> DataFrame:
    """``df`` with a seeded share of all feature values replaced by NaN."""
    u = lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(seed), i), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("features", F.transform("features", lambda x, i: F.when(u(i) < share, float("nan")).otherwise(x)))


def impute_features(df: DataFrame, how: str = "mean") -> DataFrame:
    """NaN and null features filled by the mean or median of the known ones (0 if none is known)."""
    d = dimensions(df)
    f = {"mean": F.avg, "median": F.median}[how]
    x = lambda i: F.element_at("features", i + 1)
    row = df.agg(*[f(F.when(~F.isnan(x(i)), x(i))) for i in range(d)]).first()
    fill = F.array(*[F.lit(float(v) if v is not None else 0.0) for v in row])
    return df.withColumn("features", F.zip_with("features", fill, lambda v, m: F.when(v.isNull() | F.isnan(v), m).otherwise(v)))


# Selection.
def _score(learner: Learner, df: DataFrame, kept: Sequence[int], key: str, folds: int, regression: bool) -> float:
    seen = cross_validate(learner, Keep(kept).transform(df), key, folds)
    return -rmse(seen) if regression else accuracy(seen)


def forward_selection(learner: Learner, df: DataFrame, most: int, key: str = "id", folds: int = 3, regression: bool = False) -> list[int]:
    """Features added one by one while the cross-validated score grows (SFS)."""
    held, kept, best = cut(df), [], -math.inf
    while len(kept) < most:
        score, j = max((_score(learner, held, [*kept, j], key, folds, regression), -j) for j in range(dimensions(held)) if j not in kept)
        if score <= best:
            break
        best = score
        kept.append(-j)
    return kept


def backward_selection(learner: Learner, df: DataFrame, least: int, loss: float = 0.0, key: str = "id", folds: int = 3, regression: bool = False) -> list[int]:
    """Features taken away one by one while the score falls by at most ``loss`` (SBS)."""
    held = cut(df)
    kept = list(range(dimensions(held)))
    best = _score(learner, held, kept, key, folds, regression)
    while len(kept) > least:
        score, j = max((_score(learner, held, [i for i in kept if i != j], key, folds, regression), -j) for j in kept)
        if score < best - loss:
            break
        best = max(best, score)
        kept.remove(-j)
    return kept


def bidirectional_selection(learner: Learner, df: DataFrame, n: int, key: str = "id", folds: int = 3, regression: bool = False) -> list[int]:
    """Additions and removals in turn until they meet: added features stay, removed ones stay away (BDS)."""
    held = cut(df)
    inside, left = [], list(range(dimensions(held)))
    while len(inside) < n and len(left) > n:
        _, j = max((_score(learner, held, [*inside, j], key, folds, regression), -j) for j in left if j not in inside)
        inside.append(-j)
        free = [j for j in left if j not in inside]
        if len(left) > n and free:
            _, j = max((_score(learner, held, [i for i in left if i != j], key, folds, regression), -j) for j in free)
            left.remove(-j)
    return sorted(inside if len(inside) == n else left)


def plus_minus_selection(learner: Learner, df: DataFrame, add: int, remove: int, n: int, key: str = "id", folds: int = 3, regression: bool = False) -> list[int]:
    """``add`` features in, ``remove`` out, in turn, until ``n`` are chosen (LRS)."""
    held = cut(df)
    d = dimensions(held)
    kept = [] if add > remove else list(range(d))
    while (len(kept) < n) if add > remove else (len(kept) > n):
        for _ in range(add):
            free = [j for j in range(d) if j not in kept]
            if free:
                kept.append(-max((_score(learner, held, [*kept, j], key, folds, regression), -j) for j in free)[1])
        for _ in range(remove):
            if len(kept) > 1:
                kept.remove(-max((_score(learner, held, [i for i in kept if i != j], key, folds, regression), -j) for j in kept)[1])
    return sorted(kept)[:n] if len(kept) > n else sorted(kept)


def relief(df: DataFrame, k: int = 5) -> list[float]:
    """ReliefF weights: how much more features differ to the nearest rows of other classes than to those of their own.

    Other classes count by their share; differences are relative to a feature's
    range. Neighbours are exact, from each class's own rows.
    """
    from statloom.operators.neighbors import knn_join

    d = dimensions(df)
    ends = df.agg(*[f(F.element_at("features", i + 1)) for i in range(d) for f in (F.min, F.max)]).first()
    span = [max((ends[2 * i + 1] or 0) - (ends[2 * i] or 0), 1e-300) for i in range(d)]
    rows = cut(df.select("id", F.col("features").alias("vec"), "label"))
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(counts.values())
    total = np.zeros(d)
    for c, m in sorted(counts.items()):
        near = knn_join(rows.select("id", "vec"), rows.where(F.col("label") == c).select("id", "vec"), k)
        pairs = near.join(rows.select(F.col("id").alias("q"), F.col("vec").alias("a"), "label"), "q").join(rows.select(F.col("id").alias("v"), F.col("vec").alias("b")), "v")
        away = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
        sums = pairs.select(F.posexplode(away).alias("j", "x"), F.when(F.col("label") == c, -1.0).otherwise(F.lit(m / n) / (1 - F.element_at(F.create_map(*[F.lit(v) for p in counts.items() for v in (p[0], p[1] / n)]), F.col("label")))).alias("w"))
        for r in sums.groupBy("j").agg(F.sum(F.col("x") * F.col("w")).alias("s")).collect():
            total[r.j] += r.s / span[r.j] / k / n
    return total.tolist()


def best_by_information(df: DataFrame, label: str, columns: Sequence[str], k: int) -> list[str]:
    """The ``k`` categorical columns of highest mutual information with the label."""
    from statloom.operators.transforms import mutual_information

    return [r.feature for r in mutual_information(df, label, columns).orderBy(F.desc("mutual_information"), "feature").limit(k).collect()]


# Embeddings for showing: representatives of a bounded number.
def classical_mds(df: DataFrame, k: int = 2, most: int = 1000, distance: Callable | None = None) -> DataFrame:
    """``rep, x`` of at most ``most`` representatives: positions whose distances are near those of the vectors."""
    from statloom.operators.clustering import representatives
    from statloom.operators.neighbors import _distances

    x, _, _ = representatives(df, most)
    d = distance(x) if distance else _distances(x, x)
    j = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    order = np.argsort(values)[::-1][:k]
    y = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return df.sparkSession.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(y)], "rep long, x array<double>")


def isomap(df: DataFrame, k: int = 2, neighbours: int = 10, most: int = 1000) -> DataFrame:
    """``rep, x``: classical scaling of path lengths in the neighbour graph of representatives; separate parts are joined by their nearest rows."""
    from statloom.operators.neighbors import _distances

    def paths(x: np.ndarray) -> np.ndarray:
        d = _distances(x, x)
        g = np.full_like(d, np.inf)
        near = np.argsort(d, axis=1)[:, 1 : neighbours + 1]
        for i, js in enumerate(near):
            g[i, js] = g[js, i] = d[i, js]
        np.fill_diagonal(g, 0)
        for m in range(len(x)):
            g = np.minimum(g, g[:, m : m + 1] + g[m : m + 1, :])
        while np.isinf(g).any():
            apart = np.where(np.isinf(g), d, np.inf)
            i, j = np.unravel_index(apart.argmin(), apart.shape)
            g = np.minimum(g, np.minimum(g[:, i : i + 1] + d[i, j] + g[j : j + 1, :], g[:, j : j + 1] + d[i, j] + g[i : i + 1, :]))
        return g

    return classical_mds(df, k, most, paths)


def tsne(df: DataFrame, k: int = 2, perplexity: float = 20.0, rounds: int = 300, most: int = 1000, seed: int = 0, negative: float | None = None) -> DataFrame:
    """``rep, x``: neighbour probabilities of representatives kept in few dimensions.

    With ``negative`` repulsion is weighted by that number against a sum of
    one over squared distances, as when only some far pairs are drawn.
    """
    from statloom.operators.clustering import representatives
    from statloom.operators.neighbors import _distances

    x, _, _ = representatives(df, most)
    n, d2 = len(x), _distances(x, x) ** 2
    p = np.zeros((n, n))
    aim = math.log(min(perplexity, max(n - 1, 2) / 3 + 1))
    for i in range(n):
        low, high, beta = 0.0, math.inf, 1.0
        row = np.delete(d2[i], i)
        for _ in range(60):
            e = np.exp(-(row - row.min()) * beta)
            s = e.sum()
            h = math.log(s) + beta * float(((row - row.min()) * e).sum()) / s
            if abs(h - aim) < 1e-5:
                break
            low, high = (beta, high) if h > aim else (low, beta)
            beta = beta * 2 if math.isinf(high) else (low + high) / 2
        p[i, np.arange(n) != i] = e / s
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, k))
    step = np.zeros_like(y)
    for t in range(rounds):
        q = 1 / (1 + _distances(y, y) ** 2)
        np.fill_diagonal(q, 0)
        pull = p * (12 if t < rounds // 4 else 1)
        push = negative * q / n if negative else q / q.sum()
        g = (pull - push) * q
        grad = 4 * (g.sum(axis=1)[:, None] * y - g @ y)
        step = (0.5 if t < rounds // 4 else 0.8) * step - max(n / 12, 10) * grad
        y = y + np.clip(step, -5, 5)
        y -= y.mean(axis=0)
    return df.sparkSession.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "rep long, x array<double>")
