"""Outlier scores over ``id, vec`` tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.special import erf
from statloom.operators.neighbors import knn_join
from statloom.plans.lineage import cut


class IsolationForest:
    """Trees of random cuts over small seeded samples; rows that few cuts isolate score near one.

    Each tree is grown from ``sample`` rows (the textbook's 256), so the model
    is bounded; all rows are scored.
    """

    def __init__(self, trees: int = 100, sample: int = 256, seed: int = 0) -> None:
        self.trees, self.sample, self.seed = trees, sample, seed

    @staticmethod
    def _mean_path(n: float) -> float:
        return 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else (1.0 if n == 2 else 0.0)

    def _grow(self, x: np.ndarray, depth: int, rnd: np.random.Generator) -> tuple:
        wide = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) else []
        if depth <= 0 or len(x) <= 1 or not len(wide):
            return (len(x),)
        j = int(rnd.choice(wide))
        c = float(rnd.uniform(x[:, j].min(), x[:, j].max()))
        low = x[:, j] <= c
        return j, c, self._grow(x[low], depth - 1, rnd), self._grow(x[~low], depth - 1, rnd)

    def fit(self, df: DataFrame) -> IsolationForest:
        take = min(self.trees * self.sample, 1 << 16)
        rows = df.select("vec", F.xxhash64("id", F.lit(self.seed)).alias("h"), "id").orderBy("h", "id").limit(take).collect()
        x, rnd = np.array([r.vec for r in rows], dtype=float), np.random.default_rng(self.seed)
        self.size = min(self.sample, len(x))
        depth = math.ceil(math.log2(max(self.size, 2)))
        self.grown = [self._grow(x[rnd.permutation(len(x))[: self.size]], depth, rnd) for _ in range(self.trees)]
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """``id, score``."""
        grown, norm, mean = self.grown, self._mean_path(self.size) or 1.0, self._mean_path

        def depths(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
            if len(tree) == 1:
                out[rows] += depth + mean(tree[0])
                return
            j, c, a, b = tree
            low = x[rows, j] <= c
            if low.any():
                depths(a, x, rows[low], depth + 1, out)
            if not low.all():
                depths(b, x, rows[~low], depth + 1, out)

        @F.pandas_udf("double")
        def scores(vec: pd.Series) -> pd.Series:
            x = np.stack(vec.to_numpy()).astype(float) if len(vec) else np.zeros((0, 1))
            out = np.zeros(len(x))
            for t in grown:
                depths(t, x, np.arange(len(x)), 0, out)
            return pd.Series(2 ** (-out / len(grown) / norm))

        return df.select("id", scores("vec").alias("score"))


def local_outlier_probability(vectors: DataFrame, k: int, scale: float = 3.0) -> DataFrame:
    """``id, loop``: the chance, from 0 to 1, that a row is an outlier among its exact ``k`` neighbours (LoOP)."""
    near = cut(knn_join(vectors, vectors, k))
    dist = cut(near.groupBy("q").agg((scale * F.sqrt(F.avg(F.col("distance") * F.col("distance")))).alias("p")))
    other = dist.select(F.col("q").alias("v"), F.col("p").alias("pv"))
    plof = cut(near.join(other, "v").groupBy("q").agg(F.avg("pv").alias("e")).join(dist, "q").select("q", (F.when(F.col("e") > 0, F.col("p") / F.col("e")).otherwise(1.0) - 1).alias("plof")))
    norm = plof.agg((scale * F.sqrt(F.avg(F.col("plof") * F.col("plof")))).alias("n"))  # one row
    chance = F.when(F.col("n") > 0, F.greatest(F.lit(0.0), erf(F.col("plof") / (F.col("n") * math.sqrt(2))))).otherwise(0.0)
    return plof.join(F.broadcast(norm)).select(F.col("q").alias("id"), chance.alias("loop"))


def density_outliers(df: DataFrame, log_density: Callable[[Column], Column], share: float = 0.05) -> DataFrame:
    """``id, score``: a density's logarithm less the threshold below which ``share`` of the rows lie; outliers are below zero."""
    scored = cut(df.select("id", log_density(F.col("vec")).alias("d")))
    mark = scored.agg(F.percentile_approx("d", share, 10_000).alias("t"))  # one row
    return scored.join(F.broadcast(mark)).select("id", (F.col("d") - F.col("t")).alias("score"))


class OneClassSvm:
    """A linear border around the rows: scores below zero are outside; ``nu`` bounds the share of those.

    Subgradient steps on all rows, one aggregation each.
    """

    def __init__(self, nu: float = 0.05, rounds: int = 60) -> None:
        self.nu, self.rounds = nu, rounds

    def fit(self, df: DataFrame) -> OneClassSvm:
        from statloom.operators.clustering import _dims, _sums

        d = _dims(df)
        s = _sums(df, lambda x, w: np.append(x.sum(axis=0), len(x)), d + 1)
        n = max(s[-1], 1)
        w, rho = s[:-1] / n, 0.0
        for t in range(self.rounds):
            now, r = w, rho

            def f(x: np.ndarray, _: np.ndarray, now: np.ndarray = now, r: float = r) -> np.ndarray:
                out = x @ now < r
                return np.append(x[out].sum(axis=0), out.sum())

            m = _sums(df, f, d + 1)
            eta = 1 / (t + 2)
            w = (1 - eta) * w + eta * m[:-1] / (n * self.nu)
            rho += eta * (1 - m[-1] / (n * self.nu))
        line = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        self.w = w
        self.rho = float(df.select(line.alias("s")).agg(F.percentile_approx("s", self.nu, 10_000)).first()[0] or 0.0)
        return self

    def score(self, df: DataFrame) -> DataFrame:
        line = F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(v)) for v in self.w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return df.select("id", (line - self.rho).alias("score"))
