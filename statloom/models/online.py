"""Online linear and kernel learners on a cluster, by averaging what partitions learn.

Rows are dealt by a key's hash to a fixed number of workers. In each epoch
every worker goes over its rows one by one from the common weights, and the
workers' weights are averaged, weighted by rows (iterative parameter mixing).
Only weights move. Labels are classes 0 and 1 (many classes: ``OneVsAll``), or
numbers for regression rules.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.numeric import inv_erf
from statloom.models.base import ArrayModel, Learner, Model, dimensions
from statloom.plans.lineage import cut


class State:
    """What a rule keeps: weights (the last is the bias), second-order numbers, and a step count."""

    def __init__(self, w: np.ndarray, s: np.ndarray, t: int = 0) -> None:
        self.w, self.s, self.t = w, s, t


Rule = Callable[[State, np.ndarray, float], None]


def perceptron() -> Rule:
    def step(m: State, x: np.ndarray, y: float) -> None:
        if y * (m.w @ x) <= 0:
            m.w += y * x

    return step


def passive_aggressive(c: float = 1.0, mode: str = "PA1", eps: float | None = None) -> Rule:
    """Modes PA, PA1 and PA2; with ``eps`` a regressor that tolerates that error."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        p = m.w @ x
        loss = max(0.0, 1 - y * p) if eps is None else max(0.0, abs(y - p) - eps)
        if loss > 0:
            n = x @ x
            tau = loss / (n + 1 / (2 * c)) if mode == "PA2" else loss / n
            m.w += (min(c, tau) if mode == "PA1" else tau) * (y if eps is None else math.copysign(1, y - p)) * x

    return step


def _spread(m: State, x: np.ndarray, full: bool) -> np.ndarray:
    """The covariance times a row; ``full`` covariances are square, the others diagonals."""
    return m.s.reshape(len(x), len(x)) @ x if full else m.s * x


def _narrow(m: State, sx: np.ndarray, by: float, full: bool) -> None:
    """Takes ``by`` times the product of ``sx`` with itself off the covariance."""
    m.s = m.s - by * (np.outer(sx, sx).ravel() if full else sx * sx)


def arow(r: float = 1.0, full: bool = False) -> Rule:
    """Adaptive regularisation of weights with a diagonal or full covariance."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        p = y * (m.w @ x)
        if p < 1:
            sx = _spread(m, x, full)
            beta = 1 / (x @ sx + r)
            m.w += max(0.0, 1 - p) * beta * y * sx
            _narrow(m, sx, beta, full)

    step.full = full
    return step


def scw(c: float = 1.0, eta: float = 0.9, mode: str = "SCW1", full: bool = False) -> Rule:
    """Soft confidence-weighted learning (modes CW, SCW1, SCW2), with a diagonal or full covariance."""
    phi = float(math.sqrt(2) * inv_erf(np.array([2 * eta - 1.0]))[0])
    psi, zeta = 1 + phi * phi / 2, 1 + phi * phi

    def step(m: State, x: np.ndarray, y: float) -> None:
        sx = _spread(m, x, full)
        v, p = float(x @ sx), y * float(m.w @ x)
        if v <= 0 or phi * math.sqrt(v) - p <= 0:
            return
        if mode == "SCW2":
            n = v + 1 / (2 * c)
            g = phi * math.sqrt(phi * phi * v * v * p * p + 4 * n * v * (n + v * phi * phi))
            alpha = max(0.0, (-(2 * p * n + phi * phi * p * v) + g) / (2 * (n * n + n * v * phi * phi)))
        else:
            alpha = max(0.0, (-p * psi + math.sqrt(p * p * phi**4 / 4 + v * phi * phi * zeta)) / (v * zeta))
            alpha = min(alpha, c) if mode == "SCW1" else alpha
        if alpha <= 0:
            return
        u = 0.25 * (-alpha * v * phi + math.sqrt(alpha**2 * v * v * phi * phi + 4 * v)) ** 2
        beta = alpha * phi / (math.sqrt(u) + v * alpha * phi)
        m.w += alpha * y * sx
        _narrow(m, sx, beta, full)

    step.full = full
    return step


def nherd(c: float = 1.0, full: bool = False) -> Rule:
    """Normal herding, with a diagonal or full covariance."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        p = y * (m.w @ x)
        if p < 1:
            sx = _spread(m, x, full)
            v = x @ sx
            m.w += y * max(0.0, 1 - p) / (v + 1 / c) * sx
            k = 2 * c + c * c * v
            if full:  # the inverse of the inverse plus k times the row's product with itself
                _narrow(m, sx, k / (1 + k * v), full)
            else:
                m.s = 1 / (1 / np.maximum(m.s, 1e-12) + k * x * x)

    step.full = full
    return step


def alma2(alpha: float = 0.9, b: float | None = None, c: float = math.sqrt(2)) -> Rule:
    """Approximate large margin in the Euclidean norm."""
    b = 1 / alpha if b is None else b

    def step(m: State, x: np.ndarray, y: float) -> None:
        n = math.sqrt(x @ x) or 1.0
        k = m.t + 1
        if y * (m.w @ x) / n <= (1 - alpha) * b / math.sqrt(k):
            m.w += c / math.sqrt(k) * y * x / n
            m.w /= max(1.0, math.sqrt(m.w @ m.w))
            m.t += 1

    return step


def romma(aggressive: bool = False) -> Rule:
    """Relaxed online maximum margin."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        p = m.w @ x
        if y * p >= (1 if aggressive else 1e-300):
            return
        n, w = x @ x, m.w @ m.w
        if w == 0 or n * w - p * p < 1e-12:
            m.w += y * x / max(n, 1e-12)
            return
        d = n * w - p * p
        m.w = (n * w - y * p) / d * m.w + w * (y - p) / d * x

    return step


def sgd(loss: str = "hinge", rate: float = 0.1, power: float = 0.5, l1: float = 0.0, l2: float = 0.0, delta: float = 1.0) -> Rule:
    """Stochastic gradient steps for hinge, logistic, squared, absolute or huber loss; rate falls as a power of the step.

    The L1 part shrinks towards zero after each step and stops there.
    """

    def slope(p: float, y: float) -> float:
        if loss == "hinge":
            return -y if y * p < 1 else 0.0
        if loss == "logistic":
            return -y / (1 + math.exp(min(y * p, 500)))
        d = p - y
        if loss == "squared":
            return d
        return math.copysign(1, d) if loss == "absolute" else max(-delta, min(delta, d))

    def step(m: State, x: np.ndarray, y: float) -> None:
        m.t += 1
        eta = rate / m.t**power
        g = slope(float(m.w @ x), y)
        if l2:
            m.w[:-1] *= max(0.0, 1 - eta * l2)
        if g:
            m.w -= eta * g * x
        if l1:
            m.w[:-1] = np.sign(m.w[:-1]) * np.maximum(np.abs(m.w[:-1]) - eta * l1, 0)

    return step


def truncated_gradient(rate: float = 0.1, gravity: float = 0.01, every: int = 10, most: float = math.inf) -> Rule:
    """Squared-loss gradient steps whose small weights are truncated every few steps."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        m.t += 1
        m.w += rate * (y - m.w @ x) * x / max(1.0, x @ x)
        if m.t % every == 0:
            small = np.abs(m.w[:-1]) <= most
            m.w[:-1] = np.where(small, np.sign(m.w[:-1]) * np.maximum(np.abs(m.w[:-1]) - rate * gravity * every, 0), m.w[:-1])

    return step


def pegasos(penalty: float = 1e-3) -> Rule:
    """Primal subgradient steps for a linear support vector machine."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        m.t += 1
        eta = 1 / (penalty * (m.t + 1))
        hit = y * (m.w @ x) < 1
        m.w[:-1] *= 1 - min(1.0, eta * penalty)
        if hit:
            m.w += eta * y * x
        n = math.sqrt(m.w @ m.w) * math.sqrt(penalty)
        if n > 1:
            m.w /= n

    return step


def mirror_descent(rate: float = 0.05, l1: float = 1e-3) -> Rule:
    """Mirror descent in a p-norm with p near the logarithm of the dimensions, for sparse logistic weights."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        p = max(2.0, 2 * math.log(len(m.w)))
        q = p / (p - 1)

        def link(v: np.ndarray, r: float) -> np.ndarray:
            total = float(np.sum(np.abs(v) ** r))
            return np.sign(v) * np.abs(v) ** (r - 1) / total ** ((r - 2) / r) if total > 0 else np.zeros_like(v)

        z = link(m.w, q) + rate * y / (1 + math.exp(min(y * float(m.w @ x), 500))) * x
        z[:-1] = np.sign(z[:-1]) * np.maximum(np.abs(z[:-1]) - rate * l1, 0)
        m.w = link(z, p)

    return step


def dual_coordinate(penalty: float = 1.0) -> Rule:
    """One dual coordinate step a row for the L1-loss support vector machine (a pass of dual ascent from zero)."""

    def step(m: State, x: np.ndarray, y: float) -> None:
        g = 1 - y * (m.w @ x)
        m.w += min(max(g / max(x @ x, 1e-12), 0.0), penalty) * y * x

    return step


class OnlineLinear(Learner):
    """Fits a rule by parameter mixing; predicts class 0 or 1, or the value itself for ``regression``."""

    def __init__(self, rule: Rule, epochs: int = 3, workers: int = 8, key: str = "id", regression: bool = False, averaged: bool = False, start: np.ndarray | None = None) -> None:
        self.rule, self.epochs, self.workers, self.key, self.regression, self.averaged, self.start = rule, epochs, workers, key, regression, averaged, start

    def _dealt(self, df: DataFrame) -> DataFrame:
        target = F.col("label") if self.regression else 2 * F.col("label") - 1
        rows = df.select(F.xxhash64(self.key).alias("h"), "features", target.cast("double").alias("y"))
        return cut(rows.withColumn("part", F.pmod("h", F.lit(self.workers))).repartition(self.workers, "part").sortWithinPartitions("part", "h"))

    def _begin(self, n: int) -> tuple[np.ndarray, np.ndarray, int]:
        spread = np.eye(n + 1).ravel() if getattr(self.rule, "full", False) else np.ones(n + 1)
        return np.zeros(n + 1) if self.start is None else np.array(self.start, dtype=float), spread, 0

    def fit(self, df: DataFrame) -> Model:
        state = self._begin(dimensions(df))
        dealt = self._dealt(df)
        for _ in range(self.epochs):
            state = self._epoch(dealt, *state)
        return self.model(state)

    def update(self, df: DataFrame, state: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Weights, second-order numbers and step count after one pass over more rows; ``state`` is what an earlier call returned."""
        if df.isEmpty():
            return state
        return self._epoch(self._dealt(df), *(state or self._begin(dimensions(df))))

    def model(self, state: tuple[np.ndarray, np.ndarray, int] | None) -> Model:
        """The model of a state; without one it answers 0."""
        w = self.weights = state[0] if state else np.zeros(1)
        value = lambda x: x @ w[:-1] + w[-1] if state else np.zeros(len(x))
        if self.regression:
            return ArrayModel(value)
        return ArrayModel(lambda x: np.stack((1 / (1 + np.exp(np.clip(value(x), -500, 500))), 1 / (1 + np.exp(-np.clip(value(x), -500, 500)))), axis=1), classes=2)

    def _epoch(self, rows: DataFrame, w: np.ndarray, s: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, int]:
        rule, averaged = self.rule, self.averaged

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, seen, total = State(w.copy(), s.copy(), t), 0, np.zeros_like(w)
            for batch in batches:
                for x, y in zip(batch["features"], batch["y"]):
                    rule(state, np.append(x, 1.0), y)
                    seen += 1
                    if averaged:
                        total += state.w
            if seen:
                yield pd.DataFrame({"w": [total / seen if averaged else state.w], "s": [state.s], "t": [state.t], "seen": [seen]})

        made = rows.select("features", "y").mapInPandas(task, "w array<double>, s array<double>, t long, seen long")
        both = made.select(F.posexplode(F.arrays_zip("w", "s")).alias("i", "x"), "t", "seen")
        mixed = both.groupBy("i").agg((F.sum(F.col("x.w") * F.col("seen")) / F.sum("seen")).alias("w"), (F.sum(F.col("x.s") * F.col("seen")) / F.sum("seen")).alias("s"), F.max("t").alias("t")).orderBy("i").collect()  # a row a dimension, or a cell of a full covariance
        if not mixed:
            return w, s, t
        return np.array([r.w for r in mixed[: len(w)]]), np.array([r.s for r in mixed]), mixed[0].t


class OnlineMulticlass(Learner):
    """Passive-aggressive steps on one weight vector a class: ``support`` moves all classes that score too high (SPA), else only the highest rival."""

    def __init__(self, c: float = 1.0, support: bool = True, epochs: int = 3, workers: int = 8, key: str = "id") -> None:
        self.c, self.support, self.epochs, self.workers, self.key = c, support, epochs, workers, key

    def fit(self, df: DataFrame) -> Model:
        from statloom.models.base import class_count

        k, d, c, support = class_count(df), dimensions(df), self.c, self.support

        def rule(m: State, x: np.ndarray, y: float) -> None:
            w = m.w.reshape(k, d + 1)
            s, right = w @ x, int(y)
            loss = np.maximum(1 - (s[right] - s), 0)
            loss[right] = 0
            bad = np.flatnonzero(loss > 0)
            if not len(bad):
                return
            n = x @ x
            if not support:
                bad = bad[[int(loss[bad].argmax())]]
            order = bad[np.argsort(-loss[bad], kind="stable")]
            total, used = 0.0, 0
            for j in order:  # the classes whose loss lies above the common level
                if loss[j] <= (total + loss[j]) / (used + 2) if used else False:
                    break
                total, used = total + loss[j], used + 1
            level = total / (used + 1)
            taus = np.minimum(np.maximum(loss[order[:used]] - level, 0) / n, c) if support and used > 1 else np.minimum(loss[order[:1]] / (2 * n), c)
            for j, tau in zip(order, taus):
                w[j] -= tau * x
            w[right] += taus.sum() * x

        rows = df.select(F.xxhash64(self.key).alias("h"), "features", F.col("label").cast("double").alias("y"))
        dealt = cut(rows.withColumn("part", F.pmod("h", F.lit(self.workers))).repartition(self.workers, "part").sortWithinPartitions("part", "h"))
        w, s, t = np.zeros(k * (d + 1)), np.zeros(k * (d + 1)), 0
        inner = OnlineLinear(rule)
        for _ in range(self.epochs):
            w, s, t = inner._epoch(dealt, w, s, t)
        weights = w.reshape(k, d + 1)

        def scores(x: np.ndarray) -> np.ndarray:
            z = x @ weights[:, :-1].T + weights[:, -1]
            return np.exp(z - z.max(axis=1, keepdims=True))

        return ArrayModel(scores, classes=k)


# Kernel learners with a budget.
def rbf(sigma: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def k(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-np.maximum(d, 0) / (2 * sigma * sigma))

    return k


def linear_kernel(c: float = 1.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    return lambda a, b: a @ b.T + c


class Expansion:
    """A weight vector in a kernel's space: support vectors with coefficients, at most ``budget``.

    Over budget, ``strategy`` "remove" drops the smallest coefficient, "random"
    any one, "project" moves the new vector's share to the others if that
    changes little and else removes, "merge" joins the two nearest vectors of
    the smallest coefficient, "stop" takes no more.
    """

    def __init__(self, kernel: Callable, budget: int, strategy: str, seed: int = 0) -> None:
        self.kernel, self.budget, self.strategy = kernel, budget, strategy
        self.x: np.ndarray | None = None
        self.a = np.zeros(0)
        self.random = np.random.default_rng(seed)

    def value(self, x: np.ndarray) -> float:
        return 0.0 if self.x is None or not len(self.a) else float(self.kernel(x[None, :], self.x)[0] @ self.a)

    def add(self, x: np.ndarray, a: float) -> None:
        if self.x is None:
            self.x, self.a = x[None, :].copy(), np.array([a])
            return
        if self.strategy == "project" and len(self.a):
            gram = self.kernel(self.x, self.x) + 1e-8 * np.eye(len(self.a))
            k = self.kernel(self.x, x[None, :])[:, 0]
            share = np.linalg.solve(gram, k)
            rest = float(self.kernel(x[None, :], x[None, :])[0, 0] - k @ share)
            if rest < 0.1 or len(self.a) >= self.budget:
                self.a = self.a + a * share
                return
        if len(self.a) >= self.budget:
            if self.strategy == "stop":
                return
            out = int(self.random.integers(len(self.a))) if self.strategy == "random" else int(np.abs(self.a).argmin())
            if self.strategy == "merge" and len(self.a) > 1:
                near = self.kernel(self.x[out][None, :], self.x)[0]
                near[out] = -np.inf
                other = int(near.argmax())
                total = abs(self.a[out]) + abs(self.a[other]) + 1e-300
                self.x[other] = (abs(self.a[out]) * self.x[out] + abs(self.a[other]) * self.x[other]) / total
                self.a[other] += self.a[out] * max(0.0, float(near[other]))
            self.x, self.a = np.delete(self.x, out, axis=0), np.delete(self.a, out)
        self.x, self.a = np.vstack((self.x, x[None, :])), np.append(self.a, a)


KernelRule = Callable[[Expansion, np.ndarray, float, int], None]


def kernel_perceptron(shrink: float = 1.0) -> KernelRule:
    """Perceptron steps; with ``shrink`` below one old coefficients fade (as in the forgetron)."""

    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        if y * m.value(x) <= 0:
            m.a *= shrink
            m.add(x, y)

    return step


def kernel_sgd(loss: str = "hinge", rate: float = 0.5, penalty: float = 1e-3) -> KernelRule:
    """Gradient steps for hinge, logistic, squared or epsilon-free absolute loss."""

    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        eta = rate / math.sqrt(t)
        p = m.value(x)
        m.a *= max(0.0, 1 - eta * penalty)
        g = {"hinge": -y if y * p < 1 else 0.0, "logistic": -y / (1 + math.exp(min(y * p, 500))), "squared": p - y, "absolute": math.copysign(1, p - y)}[loss]
        if g:
            m.add(x, -eta * g)

    return step


def kernel_pegasos(penalty: float = 1e-2) -> KernelRule:
    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        hit = y * m.value(x) < 1
        m.a *= 1 - 1 / (t + 1)
        if hit:
            m.add(x, y / (penalty * (t + 1)))

    return step


def kernel_alma2(alpha: float = 0.9) -> KernelRule:
    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        k = len(m.a) + 1
        if y * m.value(x) <= (1 - alpha) / alpha / math.sqrt(k):
            m.add(x, y * math.sqrt(2) / math.sqrt(k))
            n = math.sqrt(max(float(m.a @ m.kernel(m.x, m.x) @ m.a), 1e-12))
            m.a /= max(1.0, n)

    return step


def double_update(c: float = 5.0, rho: float = 0.2) -> KernelRule:
    """A misplaced row changes its own coefficient and that of the support vector it conflicts with most."""

    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        f = m.value(x)
        if y * f > 1:
            return
        best, at = -rho, -1
        if m.x is not None and len(m.a):
            k = m.kernel(x[None, :], m.x)[0]
            conflict = y * np.sign(m.a) * k
            if conflict.min() < best:
                at = int(conflict.argmin())
        loss = 1 - y * f
        if at < 0:
            m.add(x, y * min(c, loss))
            return
        w = abs(float(conflict[at]))
        g = min(c, loss / max(1 - w * w, 1e-6))
        m.a[at] += math.copysign(min(c, w * g), m.a[at])
        m.add(x, y * g)

    return step


def stochastic_keep(loss_rate: float = 0.5, most: float = 1.0, seed: int = 0) -> KernelRule:
    """Logistic steps taken at random, the likelier the worse a row is placed, so that the expansion stays sparse."""
    random = np.random.default_rng(seed)

    def step(m: Expansion, x: np.ndarray, y: float, t: int) -> None:
        p = 1 / (1 + math.exp(min(max(y * m.value(x), -500), 500)))
        chance = min(most, 2 * p)
        if random.random() < chance:
            m.add(x, loss_rate * y * p / chance)

    return step


class OnlineKernel(Learner):
    """A kernel rule on each worker's rows; the model is the mean of the workers' expansions (at most ``workers`` x ``budget`` vectors)."""

    def __init__(self, rule: KernelRule, kernel: Callable, budget: int = 100, strategy: str = "remove", workers: int = 4, epochs: int = 1, key: str = "id", regression: bool = False) -> None:
        self.rule, self.kernel, self.budget, self.strategy, self.workers, self.epochs, self.key, self.regression = rule, kernel, budget, strategy, workers, epochs, key, regression

    def fit(self, df: DataFrame) -> Model:
        rule, kernel, budget, strategy, epochs = self.rule, self.kernel, self.budget, self.strategy, self.epochs
        target = F.col("label") if self.regression else 2 * F.col("label") - 1
        rows = df.select(F.xxhash64(self.key).alias("h"), "features", target.cast("double").alias("y")).withColumn("part", F.pmod("h", F.lit(self.workers)))
        dealt = cut(rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(self.workers, "part").sortWithinPartitions("part", "epoch", "h"))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            models: dict[int, list] = {}
            for batch in batches:
                for part, x, y in zip(batch["part"], batch["features"], batch["y"]):
                    held = models.setdefault(part, [Expansion(kernel, budget, strategy), 0])
                    held[1] += 1
                    rule(held[0], np.asarray(x, dtype=float), y, held[1])
            for m, _ in models.values():
                if m.x is not None:
                    yield pd.DataFrame({"x": list(m.x), "a": m.a})

        got = dealt.select("part", "features", "y").mapInPandas(task, "x array<double>, a double").collect()  # bounded by workers x budget
        vectors = np.array([r.x for r in got]).reshape(len(got), -1)
        a = np.array([r.a for r in got]) / self.workers
        if self.regression:
            return ArrayModel(lambda x: kernel(x, vectors) @ a if len(a) else np.zeros(len(x)))

        def chances(x: np.ndarray) -> np.ndarray:
            f = np.clip(kernel(x, vectors) @ a if len(a) else np.zeros(len(x)), -500, 500)
            return np.stack((1 / (1 + np.exp(f)), 1 / (1 + np.exp(-f))), axis=1)

        return ArrayModel(chances, classes=2)
