"""Feed-forward networks trained on a cluster by averaging: every worker takes mini-batch steps on its rows, then weights are averaged."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ArrayModel, Learner, Model, class_count, dimensions
from statloom.plans.lineage import cut

# Activations: value and slope in terms of the value.
ACTIVATIONS: dict[str, tuple[Callable[[np.ndarray], np.ndarray], Callable[[np.ndarray], np.ndarray]]] = {
    "linear": (lambda z: z, np.ones_like),
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "softsign": (lambda z: z / (1 + np.abs(z)), lambda a: (1 - np.abs(a)) ** 2),
}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def start(sizes: Sequence[int], how: str = "tanh", scale: float = 0.1, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starting weights: constant, gaussian, uniform, or tanh (uniform by the layer's size); biases are zero."""
    rnd, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:]):
        if how == "constant":
            w = np.full((a, b), scale)
        elif how == "gaussian":
            w = rnd.normal(0, scale, (a, b))
        elif how == "uniform":
            w = rnd.uniform(-scale, scale, (a, b))
        else:
            w = rnd.uniform(-1, 1, (a, b)) * math.sqrt(6 / (a + b))
        out.append((w, np.zeros(b)))
    return out


def max_norm(w: np.ndarray, most: float) -> np.ndarray:
    """Columns (the weights into a unit) scaled down to a norm of at most ``most``."""
    n = np.sqrt((w * w).sum(axis=0, keepdims=True))
    return w * np.minimum(1, most / np.maximum(n, 1e-300))


class Updater:
    """A gradient step: plain sgd, momentum, nesterov, adagrad, rmsprop, adadelta, adam or rprop."""

    def __init__(self, kind: str, rate: float) -> None:
        self.kind, self.rate, self.state, self.t = kind, rate, {}, 0

    def __call__(self, key: tuple, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        s = self.state.setdefault(key, [np.zeros_like(w), np.zeros_like(w)])
        if self.kind in ("momentum", "nesterov"):
            s[0] = 0.9 * s[0] - self.rate * g
            return w + (0.9 * s[0] - self.rate * g if self.kind == "nesterov" else s[0])
        if self.kind == "adagrad":
            s[0] = s[0] + g * g
            return w - self.rate * g / (np.sqrt(s[0]) + 1e-8)
        if self.kind == "rmsprop":
            s[0] = 0.9 * s[0] + 0.1 * g * g
            return w - self.rate * g / (np.sqrt(s[0]) + 1e-8)
        if self.kind == "adadelta":
            s[0] = 0.95 * s[0] + 0.05 * g * g
            d = np.sqrt(s[1] + 1e-6) / np.sqrt(s[0] + 1e-6) * g
            s[1] = 0.95 * s[1] + 0.05 * d * d
            return w - d
        if self.kind == "adam":
            s[0], s[1] = 0.9 * s[0] + 0.1 * g, 0.999 * s[1] + 0.001 * g * g
            return w - self.rate * (s[0] / (1 - 0.9**self.t)) / (np.sqrt(s[1] / (1 - 0.999**self.t)) + 1e-8)
        if self.kind == "rprop":
            if not s[1].any():
                s[1] = np.full_like(w, self.rate)
            same = s[0] * g
            s[1] = np.clip(np.where(same > 0, s[1] * 1.2, np.where(same < 0, s[1] * 0.5, s[1])), 1e-6, 1.0)
            s[0] = np.where(same < 0, 0.0, g)
            return w - np.sign(s[0]) * s[1]
        return w - self.rate * g


class Network(Learner):
    """Hidden layers with one activation, a softmax output (or a linear one for ``regression``).

    ``drop_in`` and ``drop_hidden`` are shares of inputs and hidden values left
    out at random in training; ``most_norm`` bounds the weights into a unit.
    """

    def __init__(
        self, hidden: Sequence[int] = (16,), activation: str = "tanh", how: str = "tanh", updater: str = "adam", rate: float = 0.01, epochs: int = 20, batch: int = 32,
        l2: float = 0.0, drop_in: float = 0.0, drop_hidden: float = 0.0, most_norm: float | None = None, workers: int = 4, regression: bool = False, key: str = "id", seed: int = 0,
    ) -> None:
        self.hidden, self.activation, self.how, self.updater, self.rate, self.epochs, self.batch = list(hidden), activation, how, updater, rate, epochs, batch
        self.l2, self.drop_in, self.drop_hidden, self.most_norm, self.workers, self.regression, self.key, self.seed = l2, drop_in, drop_hidden, most_norm, workers, regression, key, seed

    def fit(self, df: DataFrame) -> Model:
        d, k = dimensions(df), 1 if self.regression else class_count(df)
        net = start([d, *self.hidden, k], self.how, seed=self.seed)
        rows = df.select(F.xxhash64(self.key).alias("h"), "features", F.col("label").cast("double").alias("label"))
        dealt = cut(rows.withColumn("part", F.pmod("h", F.lit(self.workers))).repartition(self.workers, "part").sortWithinPartitions("part", "h"))
        rounds = max(1, self.epochs // 4) if self.workers > 1 else 1  # one worker has nothing to average
        for r in range(rounds):
            net = self._round(dealt, net, self.epochs // rounds, r)
        self.net, f = net, ACTIVATIONS[self.activation][0]

        def forward(x: np.ndarray) -> np.ndarray:
            for i, (w, b) in enumerate(net):
                x = x @ w + b
                if i + 1 < len(net):
                    x = f(x)
            return x

        return ArrayModel(lambda x: forward(x)[:, 0]) if self.regression else ArrayModel(lambda x: softmax(forward(x)), classes=k)

    def _round(self, rows: DataFrame, net: list, passes: int, r: int) -> list:
        shapes = [(w.shape, b.shape) for w, b in net]
        spec = (self.activation, self.updater, self.rate, self.batch, self.l2, self.drop_in, self.drop_hidden, self.most_norm, self.regression, self.seed + 1000 * r)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, seen = [(w.copy(), b.copy()) for w, b in net], 0
            update = Updater(spec[1], spec[2])
            rnd = np.random.default_rng(spec[9])
            for frame in batches:
                if not len(frame):
                    continue
                x, y = np.stack(frame["features"]).astype(float), frame["label"].to_numpy()
                seen += len(x)
                for _ in range(passes):
                    order = rnd.permutation(len(x))
                    for i in range(0, len(x), spec[3]):
                        some = order[i : i + spec[3]]
                        own = _step(own, x[some], y[some], spec, update, rnd)
            if seen:
                yield pd.DataFrame({"v": [np.concatenate([np.concatenate((w.ravel(), b)) for w, b in own])], "n": [seen]})

        made = rows.select("features", "label").mapInPandas(task, "v array<double>, n long").select(F.posexplode("v").alias("i", "x"), "n")
        got = made.groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).orderBy("i").collect()  # a row a weight
        if not got:
            return net
        flat, at, out = np.array([g.x for g in got]), 0, []
        for ws, bs in shapes:
            n = ws[0] * ws[1]
            out.append((flat[at : at + n].reshape(ws), flat[at + n : at + n + bs[0]]))
            at += n + bs[0]
        return out


def _step(net: list, x: np.ndarray, y: np.ndarray, spec: tuple, update: Updater, rnd: np.random.Generator) -> list:
    activation, _, _, _, l2, drop_in, drop_hidden, most, regression, _ = spec
    f, slope = ACTIVATIONS[activation]
    update.t += 1
    if drop_in:
        x = x * (rnd.uniform(size=x.shape) >= drop_in) / (1 - drop_in)
    values, masks = [x], []
    for i, (w, b) in enumerate(net):
        z = values[-1] @ w + b
        if i + 1 < len(net):
            z = f(z)
            mask = (rnd.uniform(size=z.shape) >= drop_hidden) / (1 - drop_hidden) if drop_hidden else np.ones_like(z)
            masks.append((z, mask))
            z = z * mask
        values.append(z)
    if regression:
        delta = (values[-1] - y[:, None]) / len(x)
    else:
        delta = softmax(values[-1])
        delta[np.arange(len(y)), y.astype(int)] -= 1
        delta /= len(x)
    out = list(net)
    for i in range(len(net) - 1, -1, -1):
        w, b = net[i]
        gw, gb = values[i].T @ delta + l2 * w, delta.sum(axis=0)
        if i:
            own, mask = masks[i - 1]
            delta = (delta @ w.T) * mask * slope(own)
        w = update((i, 0), w, gw)
        out[i] = (max_norm(w, most) if most else w, update((i, 1), b, gb))
    return out
