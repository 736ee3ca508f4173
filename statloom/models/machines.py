"""Machines of several hyperplanes a class, trained on a cluster by dealing rows to workers whose models are averaged or joined."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ArrayModel, Learner, Model, class_count, dimensions
from statloom.plans.lineage import cut


class MultiHyperplane(Learner):
    """Each class has some weight vectors, the best of which scores; a row moves its class's best up and the best rival down (AMM).

    Vectors are added when no old one of the class scores above zero, up to
    ``most``; short ones go. Workers' vectors are joined, so the model has at
    most ``workers`` x ``most`` vectors a class.
    """

    def __init__(self, penalty: float = 1e-3, epochs: int = 5, most: int = 8, prune: float = 1e-3, workers: int = 2, key: str = "id") -> None:
        self.penalty, self.epochs, self.most, self.prune, self.workers, self.key = penalty, epochs, most, prune, workers, key

    def fit(self, df: DataFrame) -> Model:
        k, d = class_count(df), dimensions(df)
        penalty, epochs, most, prune = self.penalty, self.epochs, self.most, self.prune
        rows = df.select(F.xxhash64(self.key).alias("h"), "features", F.col("label").cast("int").alias("y")).withColumn("part", F.pmod("h", F.lit(self.workers)))
        rows = cut(rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(self.workers, "part").sortWithinPartitions("part", "epoch", "h"))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            for batch in batches:
                for part, x, y in zip(batch["part"], batch["features"], batch["y"]):
                    m = held.setdefault(part, [[[] for _ in range(k)], 0])
                    _learn(m, np.append(x, 1.0), y)
            for part, (weights, _) in held.items():
                rows = [(part, c, w) for c, ws in enumerate(weights) for w in ws]
                if rows:
                    yield pd.DataFrame(rows, columns=["part", "c", "w"])

        def _learn(m: list, x: np.ndarray, y: int) -> None:
            weights, m[1] = m[0], m[1] + 1
            t = m[1]
            best = [max((float(w @ x), i) for i, w in enumerate(ws)) if ws else (0.0, -1) for ws in weights]
            rival = max((best[c][0], c) for c in range(k) if c != y)[1] if k > 1 else y
            eta = 1 / (penalty * (t + 10))
            for ws in weights:
                for w in ws:
                    w *= 1 - min(1.0, eta * penalty)
            if best[y][0] < 1 + best[rival][0] and k > 1:
                if best[rival][1] >= 0:
                    weights[rival][best[rival][1]] -= eta * x
                if best[y][1] >= 0 and (best[y][0] > 0 or len(weights[y]) >= most):
                    weights[y][best[y][1]] += eta * x
                else:
                    weights[y].append(eta * x)
            if t % 500 == 0:
                for c in range(k):
                    kept = [w for w in weights[c] if math.sqrt(w @ w) > prune]
                    weights[c][:] = kept or weights[c]

        got = rows.select("part", "features", "y").mapInPandas(task, "part long, c int, w array<double>").collect()  # bounded by workers x classes x most
        by = {}
        for r in got:
            by.setdefault((r.part, r.c), []).append(r.w)
        parts = sorted({p for p, _ in by})

        def scores(x: np.ndarray) -> np.ndarray:
            z = np.hstack((x, np.ones((len(x), 1))))
            total = np.zeros((len(x), k))
            for p in parts:
                one = np.stack([np.max(z @ np.array(by[p, c]).T, axis=1) if (p, c) in by else np.zeros(len(x)) for c in range(k)], axis=1)
                e = np.exp(np.clip(one - one.max(axis=1, keepdims=True), -50, 0))
                total += e / e.sum(axis=1, keepdims=True)
            return total

        self.vectors, _ = by, d
        return ArrayModel(scores, classes=k)


class ConvexPolytope(Learner):
    """Two classes: a row is of class 1 if the best of some hyperplanes scores above zero; each class-1 row has one, each class-0 row meets all.

    Workers' hyperplanes are joined by averaging the scores of their machines.
    """

    def __init__(self, planes: int = 4, penalty: float = 1e-3, epochs: int = 8, workers: int = 2, entropy: float = 0.5, key: str = "id", seed: int = 0) -> None:
        self.planes, self.penalty, self.epochs, self.workers, self.entropy, self.key, self.seed = planes, penalty, epochs, workers, entropy, key, seed

    def fit(self, df: DataFrame) -> Model:
        n, penalty, epochs, entropy, seed = self.planes, self.penalty, self.epochs, self.entropy, self.seed
        rows = df.select(F.xxhash64(self.key).alias("h"), "features", (2 * F.col("label") - 1).alias("y")).withColumn("part", F.pmod("h", F.lit(self.workers)))
        rows = cut(rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(self.workers, "part").sortWithinPartitions("part", "epoch", "h"))

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list] = {}
            for batch in batches:
                for part, x, y in zip(batch["part"], batch["features"], batch["y"]):
                    z = np.append(x, 1.0)
                    if part not in held:
                        held[part] = [np.random.default_rng(seed).normal(0, 0.1, (n, len(z))), 0, np.zeros(n)]
                    m = held[part]
                    m[1] += 1
                    w, t, load = m[0], m[1], m[2]
                    s = w @ z
                    eta = 1 / (penalty * (t + 1 / penalty))
                    w *= 1 - eta * penalty
                    if y > 0:
                        free = np.flatnonzero(load <= load.mean() * (1 + entropy) + 1)  # no plane takes all rows
                        j = int(free[s[free].argmax()])
                        load[j] += 1
                        if s[j] < 1:
                            w[j] += eta * z
                    else:
                        for j in np.flatnonzero(s > -1):
                            w[j] -= eta * z
            for part, (w, _, _) in held.items():
                yield pd.DataFrame({"part": part, "w": list(w)})

        got = rows.select("part", "features", "y").mapInPandas(task, "part long, w array<double>").collect()  # workers x planes
        parts = {}
        for r in got:
            parts.setdefault(r.part, []).append(r.w)
        stacks = [np.array(v) for _, v in sorted(parts.items())]

        def scores(x: np.ndarray) -> np.ndarray:
            z = np.hstack((x, np.ones((len(x), 1))))
            f = np.clip(np.mean([np.max(z @ w.T, axis=1) for w in stacks], axis=0) if stacks else np.zeros(len(x)), -500, 500)
            return np.stack((1 / (1 + np.exp(f)), 1 / (1 + np.exp(-f))), axis=1)

        return ArrayModel(scores, classes=2)
