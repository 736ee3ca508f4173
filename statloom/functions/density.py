"""Kernel densities and multivariate densities as columns and joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import ln_gamma
from statloom.plans.lineage import cut


def _inside(u: Column, value: Column) -> Column:
    return F.when(F.abs(u) <= 1, value).otherwise(0.0)


def _upto(u: Column, value: Column) -> Column:
    return F.when(u < -1, 0.0).when(u > 1, 1.0).otherwise(value)


# Kernel functions of a scaled distance: name -> (density, integral from below, second moment).
KERNELS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column], float]] = {
    "uniform": (lambda u: _inside(u, F.lit(0.5)), lambda u: _upto(u, (u + 1) / 2), 1 / 3),
    "epanechnikov": (lambda u: _inside(u, 0.75 * (1 - u * u)), lambda u: _upto(u, (2 + 3 * u - u * u * u) / 4), 1 / 5),
    "biweight": (lambda u: _inside(u, 15 / 16 * (1 - u * u) * (1 - u * u)), lambda u: _upto(u, (8 + 15 * u - 10 * u * u * u + 3 * F.pow(u, F.lit(5.0))) / 16), 1 / 7),
    "triweight": (lambda u: _inside(u, 35 / 32 * (1 - u * u) * (1 - u * u) * (1 - u * u)), lambda u: _upto(u, 0.5 + 35 / 32 * (u - u * u * u + 0.6 * F.pow(u, F.lit(5.0)) - F.pow(u, F.lit(7.0)) / 7)), 1 / 9),
    "gauss": (lambda u: F.exp(-u * u / 2) / math.sqrt(2 * math.pi), None, 1.0),
}


def bandwidth(df: DataFrame, value: str) -> float:
    """The normal-reference bandwidth: 1.06 deviations by the fifth root of the count."""
    n, sd = df.agg(F.count(value), F.stddev_samp(value)).first()
    return 1.06 * (sd or 1.0) * max(n, 1) ** -0.2


def kde(df: DataFrame, value: str, points: Sequence[float], width: float | None = None, kernel: str = "epanechnikov", weight: str | None = None) -> DataFrame:
    """``point, density, cumulative`` of all rows' kernels at given points; partial sums a point before the shuffle."""
    h = width or bandwidth(df, value)
    k, total, _ = KERNELS[kernel]
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"), w.alias("w"), at)
    u = (F.col("point") - F.col("x")) / h
    if total is None:
        from statloom.functions.distributions import Normal

        upto = Normal().column("cdf", u)
    else:
        upto = total(u)
    sums = x.groupBy("point").agg((F.sum(F.col("w") * k(u)) / F.sum("w") / h).alias("density"), (F.sum(F.col("w") * upto) / F.sum("w")).alias("cumulative"))
    return sums


def metric_kde(queries: DataFrame, vectors: DataFrame, width: float, kernel: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``id, density``: each query's mean kernel of its distances to all vectors within three widths (Epanechnikov by default: one)."""
    from statloom.operators.neighbors import range_join

    k = F.col("distance") / width
    near = range_join(queries, vectors, width)
    n = vectors.count()
    sums = near.groupBy(F.col("q").alias("id")).agg((F.sum(0.75 * (1 - k * k)) / (n * width)).alias("density"))
    return queries.select("id").join(sums, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def product_kde(queries: DataFrame, vectors: DataFrame, widths: Sequence[float], block: int = 2048) -> DataFrame:
    """``id, density``: the mean over all vectors of the product of Gaussian kernels of each dimension, in blocks with one partial sum a query."""
    h = np.array(widths, dtype=float)
    nv, nq = max(1, -(-vectors.count() // block)), max(1, -(-queries.count() // block))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = vectors.select("id", "vec", at(nv).alias("a"), F.lit(0).alias("side")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = queries.select("id", "vec", at(nq).alias("b"), F.lit(1).alias("side")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    rows = left.unionByName(right.select(left.columns)).repartition("a", "b").sortWithinPartitions("a", "b", "side", "id")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held = None, []
        for batch in batches:
            for (a, b, side), some in batch.groupby(["a", "b", "side"], sort=True):
                if (a, b) != here:
                    here, held = (a, b), []
                x = np.stack(some["vec"]).astype(float) / h
                if side == 0:
                    held.append(x)
                elif held:
                    v = np.concatenate(held)
                    d = np.maximum((x * x).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * x @ v.T, 0)
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "s": np.exp(-d / 2).sum(axis=1), "n": len(v)})

    norm = float(np.prod(h) * (2 * math.pi) ** (len(h) / 2))
    sums = rows.mapInPandas(task, "id long, s double, n long").groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return sums.select("id", (F.col("s") / F.col("n") / norm).alias("density"))


def _lit(xs: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class NormalM:
    """A multivariate normal: ``log_pdf`` is a column of a vector column."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray) -> None:
        self.mean, self.covariance = np.asarray(mean, float), np.asarray(covariance, float)

    @staticmethod
    def fit(df: DataFrame, ridge: float = 0.0) -> NormalM:
        """Mean and population covariance of ``vec``, in one pass."""
        from statloom.operators.features import _moments

        mean, cov, _ = _moments(df.select(F.col("vec").alias("features")))
        return NormalM(mean, cov + ridge * np.eye(len(mean)))

    def distance(self, v: Column) -> Column:
        """Squared Mahalanobis distance, by the inverse's triangular root."""
        root = np.linalg.cholesky(np.linalg.inv(self.covariance))
        centred = F.zip_with(v, _lit(self.mean), lambda a, b: a - b)
        parts = F.array(*[_dot(centred, _lit(root[:, j])) for j in range(root.shape[1])])
        return _dot(parts, parts)

    def log_pdf(self, v: Column) -> Column:
        ln = float(np.linalg.slogdet(self.covariance)[1]) + len(self.mean) * math.log(2 * math.pi)
        return -0.5 * (self.distance(v) + ln)

    def sample(self, spark, n: int, seed: int = 0) -> DataFrame:
        """``id, vec``: seeded samples."""
        root = np.linalg.cholesky(self.covariance)
        z = F.array(*[F.randn(seed * 1000 + i) for i in range(len(self.mean))])
        rows = F.array(*[F.lit(float(self.mean[i])) + _dot(F.col("z"), _lit(root[i])) for i in range(len(self.mean))])
        return spark.range(n).select("id", z.alias("z")).select("id", rows.alias("vec"))


def robust_normal(df: DataFrame, share: float = 0.75, rounds: int = 20, starts: int = 3, seed: int = 0) -> NormalM:
    """A normal fitted to the ``share`` of rows of least covariance determinant, by concentration steps.

    Each step is one aggregation for the threshold of distances and one for the
    moments of the rows within it.
    """
    rows = cut(df.select("id", "vec"))
    d = len(rows.first().vec)
    best = None
    for s in range(starts):
        few = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + s)), F.lit(1 << 20)) < int((1 << 20) * max(0.1, min(1.0, 20 * d / max(rows.count(), 1)))))
        now, last = NormalM.fit(few, 1e-9), math.inf
        for _ in range(rounds):
            far = rows.select("vec", now.distance(F.col("vec")).alias("m"))
            mark = far.agg(F.percentile_approx("m", share, 10_000)).first()[0]
            now = NormalM.fit(far.where(F.col("m") <= mark), 1e-9)
            det = float(np.linalg.slogdet(now.covariance)[1])
            if det > last - 1e-9:
                break
            last = det
        if best is None or last < best[0]:
            best = (last, now)
    return best[1]


def dirichlet_log_pdf(v: Column, alphas: Sequence[float]) -> Column:
    a = np.asarray(alphas, float)
    norm = float(ln_gamma(a.sum()) - ln_gamma(a).sum())
    return norm + F.aggregate(F.zip_with(v, _lit(a), lambda x, k: (k - 1) * F.log(x)), F.lit(0.0), lambda s, x: s + x)


def symmetric_dirichlet_log_pdf(v: Column, alpha: float, n: int) -> Column:
    return dirichlet_log_pdf(v, [alpha] * n)


def independent_log_pdf(v: Column, distributions: Sequence) -> Column:
    """The sum of each dimension's log density."""
    out = F.lit(0.0)
    for i, d in enumerate(distributions):
        out = out + d.column("log_pdf", F.element_at(v, i + 1))
    return out


def trapezoid(f: Callable[[Column], Column], low: float, high: float, n: int, spark) -> float:
    """The integral of a column function by the trapezoid rule over a distributed grid of ``n`` steps."""
    h = (high - low) / n
    x = spark.range(n + 1).select((F.lit(low) + F.col("id") * h).alias("x"), F.when((F.col("id") == 0) | (F.col("id") == n), 0.5).otherwise(1.0).alias("w"))
    return float(x.agg(F.sum(F.col("w") * f(F.col("x")))).first()[0] * h)
