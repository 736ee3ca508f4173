"""Bayesian classifiers from counts and moments: one aggregation to fit, a column to predict."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import ln_gamma
from statloom.models.base import ArrayModel, ColumnModel, Learner, Model, arg_max, class_count, dimensions


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1.0)


def _total(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def _from_logs(logs: Sequence[Column]) -> Column:
    """Shares that follow from the logs; every log, the largest and the sum are evaluated once a row."""
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def of_logs(xs: Column) -> Column:
        shares = once(F.array_max(xs), lambda top: F.transform(xs, lambda v: F.exp(v - top)))
        return once(shares, lambda s: once(F.aggregate(s, F.lit(0.0), lambda a, v: a + v), lambda all_: F.transform(s, lambda v: v / all_)))

    return once(F.array(*logs), of_logs)


class GaussianSums:
    """Mergeable sums for Gaussian naive Bayes: weight, mean and squared deviation of every class and dimension."""

    def __init__(self, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        self.n, self.mean, self.m2 = n, mean, m2

    @staticmethod
    def of(df: DataFrame, classes: int | None = None) -> GaussianSums:
        k, d = classes or class_count(df), dimensions(df)
        w = _weight(df)
        long = df.select("label", w.alias("w"), F.posexplode("features").alias("j", "x")).where("x is not null and not isnan(x)")
        rows = long.groupBy("label", "j").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("s"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("q")).collect()  # classes x dimensions
        n, mean, m2 = np.zeros((k, d)), np.zeros((k, d)), np.zeros((k, d))
        for r in rows:
            i = (int(r.label), r.j)
            n[i] = r.n
            if r.n:
                mean[i] = r.s / r.n
                m2[i] = max(0.0, r.q - r.n * mean[i] ** 2)
        return GaussianSums(n, mean, m2)

    def merge(self, other: GaussianSums) -> GaussianSums:
        """The sums of both tables, by means and squared deviations."""
        n = self.n + other.n
        safe = np.maximum(n, 1e-300)
        gap = other.mean - self.mean
        return GaussianSums(n, self.mean + gap * other.n / safe, self.m2 + other.m2 + gap * gap * self.n * other.n / safe)


class GaussianNaiveBayes(Learner):
    """Normal densities by class and dimension; ``update`` goes on from a fit with more rows."""

    def __init__(self, floor: float = 1e-9) -> None:
        self.floor, self.sums = floor, None

    def fit(self, df: DataFrame) -> Model:
        self.sums = GaussianSums.of(df)
        return self.model()

    def update(self, df: DataFrame) -> Model:
        new = GaussianSums.of(df, len(self.sums.n) if self.sums else None)
        self.sums = new if self.sums is None else self.sums.merge(new)
        return self.model()

    def model(self) -> Model:
        s = self.sums
        counts = s.n.max(axis=1)
        prior = np.log((counts + 1) / (counts.sum() + len(counts)))
        var = s.m2 / np.maximum(s.n, 1e-300) + self.floor

        def scores(x: np.ndarray) -> np.ndarray:
            z = prior - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + (((x[:, None, :] - s.mean) ** 2) / var).sum(axis=2))
            return np.exp(z - z.max(axis=1, keepdims=True))

        return ArrayModel(scores, classes=len(counts))


class MultivariateNormals(Learner):
    """A normal density with a full covariance for every class."""

    def __init__(self, floor: float = 1e-6, priors: bool = True) -> None:
        self.floor, self.priors = floor, priors

    def fit(self, df: DataFrame) -> Model:
        k, d = class_count(df), dimensions(df)
        w = _weight(df)
        pairs = F.flatten(F.transform("features", lambda x: F.transform("features", lambda y: x * y)))
        long = df.select("label", w.alias("w"), F.posexplode(F.concat(F.array(F.lit(1.0)), "features", pairs)).alias("j", "x"))
        rows = long.groupBy("label", "j").agg(F.sum(F.col("w") * F.col("x")).alias("s")).collect()  # classes x squared dimensions
        sums = np.zeros((k, 1 + d + d * d))
        for r in rows:
            sums[int(r.label), r.j] = r.s
        n = np.maximum(sums[:, 0], 1e-300)
        mean = sums[:, 1 : d + 1] / n[:, None]
        parts = []
        for i in range(k):
            cov = sums[i, d + 1 :].reshape(d, d) / n[i] - np.outer(mean[i], mean[i]) + self.floor * np.eye(d)
            sign, ln = np.linalg.slogdet(cov)
            parts.append((np.linalg.inv(cov), ln))
        prior = np.log((sums[:, 0] + 1) / (sums[:, 0].sum() + k)) if self.priors else np.zeros(k)

        def scores(x: np.ndarray) -> np.ndarray:
            z = np.stack([prior[i] - 0.5 * (ln + np.einsum("ij,jk,ik->i", x - mean[i], inv, x - mean[i])) for i, (inv, ln) in enumerate(parts)], axis=1)
            return np.exp(z - z.max(axis=1, keepdims=True))

        return ArrayModel(scores, classes=k)


class MultinomialNaiveBayes(Learner):
    """Counts of non-negative features by class with additive smoothing."""

    def __init__(self, smooth: float = 1.0) -> None:
        self.smooth = smooth

    def fit(self, df: DataFrame) -> Model:
        k, d, w = class_count(df), dimensions(df), _weight(df)
        long = df.select("label", w.alias("w"), F.posexplode(F.concat(F.array(F.lit(1.0)), "features")).alias("j", "x"))
        sums = np.zeros((k, d + 1))
        for r in long.groupBy("label", "j").agg(F.sum(F.col("w") * F.col("x")).alias("s")).collect():
            sums[int(r.label), r.j] = r.s
        logs = np.log(sums[:, 1:] + self.smooth) - np.log(sums[:, 1:].sum(axis=1, keepdims=True) + self.smooth * d)
        prior = np.log((sums[:, 0] + 1) / (sums[:, 0].sum() + k))

        def scores(x: np.ndarray) -> np.ndarray:
            z = prior + x @ logs.T
            return np.exp(z - z.max(axis=1, keepdims=True))

        return ArrayModel(scores, classes=k)


def conditional_table(df: DataFrame, label: str, given: Sequence[str] = (), smooth: float = 1.0) -> DataFrame:
    """``*given, label, probability``: smoothed shares of the label's values under each combination that occurs."""
    values = df.select(label).where(F.col(label).isNotNull()).distinct()
    cells = df.where(F.col(label).isNotNull()).groupBy(*given, label).agg(F.count("*").alias("n"))
    seen = cells.groupBy(*given).agg(F.sum("n").alias("total"))
    size = values.agg(F.count("*").alias("size"))
    full = seen.join(F.broadcast(values.join(F.broadcast(size)))) if given else values.join(F.broadcast(size)).join(F.broadcast(seen))
    out = full.join(cells, [*given, label], "left")
    return out.select(*given, label, ((F.coalesce("n", F.lit(0)) + smooth) / (F.col("total") + smooth * F.col("size"))).alias("probability"))


class _Categorical(Model):
    """Class scores that are columns over named categorical columns."""

    def __init__(self, logs: Sequence[Column]) -> None:
        self.logs = list(logs)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", _from_logs(self.logs)).withColumn("prediction", arg_max(F.col("probability")))


def _lookup(table: Mapping[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def _text(*columns: str) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])


class OneDependence(Learner):
    """Naive Bayes whose attributes depend on the class and one parent attribute (ODE).

    Works on named categorical columns and ``label``; null is a category.
    Category combinations are expected to be few: the counts are held as maps.
    """

    def __init__(self, columns: Sequence[str], parent: str, smooth: float = 1.0) -> None:
        self.columns, self.parent, self.smooth = list(columns), parent, smooth

    def joint_logs(self, df: DataFrame, classes: int) -> list[Column]:
        """ln of the joint share of the row and each class."""
        w, parent = _weight(df), self.parent
        others = [c for c in self.columns if c != parent]
        base = {(int(r.label), r.p): r.n for r in df.groupBy("label", _text(parent).alias("p")).agg(F.sum(w).alias("n")).collect()}
        total = sum(base.values())
        values = len({p for _, p in base})
        out = []
        pair = {}
        sizes = {}
        for c in others:
            rows = df.groupBy("label", _text(parent, c).alias("pc"), _text(c).alias("c")).agg(F.sum(w).alias("n")).collect()
            sizes[c] = len({r.c for r in rows})
            pair[c] = {(int(r.label), r.pc): r.n for r in rows}
        for k in range(classes):
            prior = {p: math.log((n + self.smooth) / (total + self.smooth * classes * values)) for (kk, p), n in base.items() if kk == k}
            log = _lookup(prior, _text(parent), math.log(self.smooth / (total + self.smooth * classes * values)))
            for c in others:
                cells = {}
                for (kk, pc), n in pair[c].items():
                    if kk == k:
                        p = pc.split("\x1f")[0]
                        cells[pc] = math.log((n + self.smooth) / (base[k, p] + self.smooth * sizes[c]))
                known = {p: math.log(self.smooth / (n + self.smooth * sizes[c])) for (kk, p), n in base.items() if kk == k}
                default = _lookup(known, _text(parent), -math.log(sizes[c]))
                log = log + (F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for q in cells.items() for x in q]), _text(parent, c)), default) if cells else default)
            out.append(log)
        return out

    def fit(self, df: DataFrame) -> Model:
        return _Categorical(self.joint_logs(df, class_count(df)))


class AveragedOneDependence(Learner):
    """The mean of one-dependence models over all parents that are frequent enough (AODE)."""

    def __init__(self, columns: Sequence[str], smooth: float = 1.0) -> None:
        self.columns, self.smooth = list(columns), smooth

    def fit(self, df: DataFrame) -> Model:
        k = class_count(df)
        parts = [OneDependence(self.columns, c, self.smooth).joint_logs(df, k) for c in self.columns]
        logs = [F.log(_total([F.exp(p[i]) for p in parts]) + 1e-300) for i in range(k)]
        return _Categorical(logs)


def network_score(df: DataFrame, child: str, parents: Sequence[str]) -> float:
    """ln of the K2 score of a child under its parents, from one contingency table."""
    cells = df.groupBy(*parents, child).agg(F.count("*").alias("n"))
    size = df.agg(F.count_distinct(_text(child))).first()[0] or 1
    sums = cells.groupBy(*parents).agg(F.collect_list("n").alias("ns"))

    total = 0.0
    for r in sums.toLocalIterator():
        ns = np.array(r.ns, dtype=float)
        total += float(ln_gamma(size) - ln_gamma(ns.sum() + size) + ln_gamma(ns + 1).sum())
    return total


def k2_structure(df: DataFrame, order: Sequence[str], most: int = 2) -> dict[str, list[str]]:
    """Parents of each column among those before it, added greedily while the K2 score grows."""
    out: dict[str, list[str]] = {}
    for i, child in enumerate(order):
        parents: list[str] = []
        best = network_score(df, child, parents)
        while len(parents) < most:
            tried = [(network_score(df, child, [*parents, c]), c) for c in order[:i] if c not in parents]
            if not tried or max(tried)[0] <= best:
                break
            best, chosen = max(tried)
            parents.append(chosen)
        out[child] = parents
    return out


class BayesNetwork(Learner):
    """A discrete Bayesian network over categorical columns and ``label``; ``parents`` names each column's parents."""

    def __init__(self, parents: Mapping[str, Sequence[str]], smooth: float = 1.0) -> None:
        self.parents, self.smooth = {k: list(v) for k, v in parents.items()}, smooth

    def fit(self, df: DataFrame) -> Model:
        classes = class_count(df)
        logs = [F.lit(0.0)] * classes
        for child, above in self.parents.items():
            size = df.agg(F.count_distinct(_text(child))).first()[0] or 1
            cells = df.groupBy(_text(*above).alias("p") if above else F.lit("").alias("p"), _text(child).alias("c")).agg(F.count("*").alias("n")).collect()
            sums: dict[str, float] = {}
            for r in cells:
                sums[r.p] = sums.get(r.p, 0) + r.n
            table = {r.p + "\x1e" + r.c: math.log((r.n + self.smooth) / (sums[r.p] + self.smooth * size)) for r in cells}
            empty = {p: math.log(self.smooth / (n + self.smooth * size)) for p, n in sums.items()}
            for k in range(classes):
                name = lambda c, k=k: F.lit(str(float(k))) if c == "label" else F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
                p = F.concat_ws("\x1f", *[name(c) for c in above]) if above else F.lit("")
                default = _lookup(empty, p, -math.log(size))
                logs[k] = logs[k] + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for q in table.items() for x in q]), F.concat(p, F.lit("\x1e"), name(child))), default)
        return _Categorical(logs)


class BestClassDistribution(Learner):
    """The class whose density (any multivariate one, by ``fit_density``) of the row is highest, times its prior."""

    def __init__(self, fit_density, priors: bool = True) -> None:
        self.fit_density, self.priors = fit_density, priors

    def fit(self, df: DataFrame) -> Model:
        k = class_count(df)
        counts = {int(r.label): r.n for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        logs = [self.fit_density(df.where(F.col("label") == i)) for i in range(k)]
        prior = [math.log((counts.get(i, 0) + 1) / (total + k)) if self.priors else 0.0 for i in range(k)]
        return ColumnModel(lambda x: arg_max(_from_logs([f(x) + p for f, p in zip(logs, prior)])), lambda x: _from_logs([f(x) + p for f, p in zip(logs, prior)]))
