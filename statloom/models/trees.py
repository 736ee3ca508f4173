"""Trees that ``pyspark.ml`` has not: ID3, extremely randomised trees, pruning, importances, impurities.

A tree is grown level by level: one aggregation over all rows scores the splits
of all open nodes, and only these sums reach the driver (nodes x candidates x
classes). The grown tree is one column expression.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.models.base import Learner, Model, class_count, dimensions
from statloom.models.ensemble import Mean, Vote, _few


# Impurity of class weights in an array; gains are the parent's less the children's mean.
def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def gini(counts: Column) -> Column:
    return 1 - _sum(F.transform(_shares(counts), lambda p: p * p))


def entropy(counts: Column) -> Column:
    """In bits."""
    return -_sum(F.transform(_shares(counts), lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def classification_error(counts: Column) -> Column:
    return 1 - F.array_max(_shares(counts))


def _gain(measure, parts: Sequence[Column]) -> Column:
    whole = parts[0]
    for p in parts[1:]:
        whole = F.zip_with(whole, p, lambda a, b: a + b)
    total, out = _sum(whole), measure(whole)
    for p in parts:
        out = out - F.when(total > 0, _sum(p) / total).otherwise(0.0) * measure(p)
    return out


def gain(parts: Sequence[Column], measure: str = "information") -> Column:
    """Gain of a split into parts of class weights: information, ratio, nmi, gini or error.

    The ratio divides by one plus the split's natural entropy; nmi is twice the
    information over the sum of both entropies.
    """
    if measure == "gini":
        return _gain(gini, parts)
    if measure == "error":
        return _gain(classification_error, parts)
    info = _gain(entropy, parts)
    if measure == "information":
        return info
    sizes = F.array(*[_sum(p) for p in parts])
    whole = parts[0]
    for p in parts[1:]:
        whole = F.zip_with(whole, p, lambda a, b: a + b)
    if measure == "ratio":
        return info / (1 + entropy(sizes) * F.log(F.lit(2.0)))
    if measure == "nmi":
        return 2 * info / (entropy(whole) + entropy(sizes))
    raise ValueError(f"no measure {measure}")


@dataclass
class Node:
    """A node: a leaf's value, or a test and children (by category, or [below or equal, above])."""

    counts: np.ndarray
    column: int | str | None = None
    cut: float | None = None
    kids: dict = field(default_factory=dict)
    gain: float = 0.0
    id: int = 0

    def value(self) -> list[float]:
        total = self.counts.sum()
        return (self.counts / total if total else np.full(len(self.counts), 1 / len(self.counts))).tolist()

    def leaves(self) -> list[Node]:
        return [self] if not self.kids else [x for k in self.kids.values() for x in k.leaves()]

    def inner(self) -> list[Node]:
        return [self, *(x for k in self.kids.values() for x in k.inner())] if self.kids else []


def _place(node: Node, read) -> Column:
    """The id of the leaf that a row reaches."""
    if not node.kids:
        return F.lit(node.id)
    if node.cut is not None:
        return F.when(read(node.column) <= node.cut, _place(node.kids[0], read)).otherwise(_place(node.kids[1], read))
    out = None
    for value, kid in node.kids.items():
        test = read(node.column).isNull() if value is None else read(node.column) == F.lit(value)
        out = F.when(test, _place(kid, read)) if out is None else out.when(test, _place(kid, read))
    return out.otherwise(F.lit(node.id))


class TreeModel(Model):
    """Predicts class shares (or, for ``regression``, means) at a row's leaf."""

    def __init__(self, root: Node, read, regression: bool = False) -> None:
        self.root, self.read, self.regression = root, read, regression
        stack, n = [root], 0
        while stack:
            node = stack.pop()
            node.id, n = n, n + 1
            stack.extend(node.kids.values())

    def transform(self, df: DataFrame) -> DataFrame:
        every, stack = {}, [self.root]
        while stack:
            node = stack.pop()
            every[node.id] = node
            stack.extend(node.kids.values())
        out = df.withColumn("__leaf", _place(self.root, self.read))
        order = [every[i] for i in range(len(every))]
        if self.regression:
            value = F.array(*[F.lit(float(n.counts[1] / n.counts[0]) if n.counts[0] else 0.0) for n in order])
            return out.withColumn("prediction", F.element_at(value, F.col("__leaf") + 1)).drop("__leaf")
        shares = F.array(*[F.array(*[F.lit(float(v)) for v in n.value()]) for n in order])
        out = out.withColumn("probability", F.element_at(shares, F.col("__leaf") + 1)).drop("__leaf")
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0] / max(p.sum(), 1e-300)
    return float(-(p * np.log2(p)).sum())


def _measure(name: str):
    return {"information": _entropy, "gini": lambda c: float(1 - ((c / max(c.sum(), 1e-300)) ** 2).sum()), "error": lambda c: float(1 - c.max() / max(c.sum(), 1e-300))}[name]


class Id3(Learner):
    """A tree over categorical columns that splits by every value, the best information gain first."""

    def __init__(self, columns: Sequence[str], depth: int = 6, least: float = 1.0, measure: str = "information") -> None:
        self.columns, self.depth, self.least, self.measure = list(columns), depth, least, measure

    def fit(self, df: DataFrame) -> Model:
        k, w = class_count(df), F.col("weight") if "weight" in df.columns else F.lit(1.0)
        score = _measure(self.measure)
        root = Node(np.zeros(k))
        for r in df.groupBy("label").agg(F.sum(w).alias("n")).collect():
            root.counts[int(r.label)] = r.n
        open_ = [(root, frozenset(self.columns))]
        for _ in range(self.depth):
            for i, (node, _) in enumerate(open_):
                node.id = i + 1
            open_ = [(n, left) for n, left in open_ if left and (n.counts > 0).sum() > 1]
            if not open_:
                break
            for node in _all(root):
                node.id = 0
            for i, (node, _) in enumerate(open_):
                node.id = i + 1
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.columns])).alias("x")
            cells = df.select(_place(root, lambda c: F.col(c).cast("string")).alias("__at"), "label", w.alias("w"), pairs).where("__at > 0").groupBy("__at", "label", "x.c", "x.v").agg(F.sum("w").alias("n"))
            sums: dict = {}
            for r in cells.collect():
                sums.setdefault(r["__at"], {}).setdefault(r.c, {}).setdefault(r.v, np.zeros(k))[int(r.label)] += r.n
            next_ = []
            for node, left in open_:
                best = (0.0, None)
                for c in sorted(left):
                    parts = sums[node.id][c]
                    if len(parts) < 2:
                        continue
                    got = score(node.counts) - sum(p.sum() * score(p) for p in parts.values()) / node.counts.sum()
                    if got > best[0] + 1e-12:
                        best = (got, c)
                if best[1] is None:
                    continue
                node.gain, node.column = best
                node.kids = {v: Node(p) for v, p in sums[node.id][best[1]].items()}
                next_ += [(kid, left - {best[1]}) for kid in node.kids.values() if kid.counts.sum() > self.least]
            open_ = next_
        return TreeModel(root, lambda c: F.col(c).cast("string"))


def _all(root: Node) -> list[Node]:
    return [*root.inner(), *root.leaves()]


class ExtraTree(Learner):
    """A tree of random cuts: a node draws features and a cut between each one's least and largest value, and takes the best.

    With ``exact`` the cut is the best of ``tries`` random ones a feature (a
    random decision tree); ``regression`` splits by variance.
    """

    sums = True

    def __init__(self, depth: int = 6, features: int | None = None, tries: int = 1, least: float = 2.0, measure: str = "gini", seed: int = 0, regression: bool = False) -> None:
        self.depth, self.features, self.tries, self.least, self.measure, self.seed, self.regression = depth, features, tries, least, measure, seed, regression

    def fit(self, df: DataFrame) -> Model:
        rnd = random.Random(self.seed)
        d, w = dimensions(df), F.col("weight") if "weight" in df.columns else F.lit(1.0)
        k = 3 if self.regression else class_count(df)
        per = self.features or max(1, round(d**0.5))
        what = [w, w * F.col("label"), w * F.col("label") * F.col("label")] if self.regression else [F.when(F.col("label") == i, w).otherwise(0.0) for i in range(k)]
        read = lambda j: F.element_at("features", j + 1)
        score = (lambda c: c[2] / max(c[0], 1e-300) - (c[1] / max(c[0], 1e-300)) ** 2) if self.regression else _measure(self.measure)
        size = (lambda c: c[0]) if self.regression else (lambda c: c.sum())
        first = df.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(what)]).first()
        root = Node(np.array([v or 0.0 for v in first]))
        open_ = [root]
        for _ in range(self.depth):
            open_ = [n for n in open_ if size(n.counts) >= self.least and score(n.counts) > 1e-12]
            if not open_:
                break
            for node in _all(root):
                node.id = 0
            for i, node in enumerate(open_):
                node.id = i + 1
            at = df.withColumn("__at", _place(root, read)).where("__at > 0")
            drawn = {node.id: rnd.sample(range(d), min(per, d)) for node in open_}
            used = sorted({j for js in drawn.values() for j in js})
            ends = {r["__at"]: r for r in at.groupBy("__at").agg(*[f(read(j)).alias(f"{n}{j}") for j in used for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
            cuts: dict[int, list[tuple[int, float]]] = {}
            for node in open_:
                r = ends.get(node.id)
                cuts[node.id] = [(j, rnd.uniform(r[f"lo{j}"], r[f"hi{j}"])) for j in drawn[node.id] for _ in range(self.tries) if r is not None and r[f"lo{j}"] is not None and r[f"lo{j}"] < r[f"hi{j}"]] if r is not None else []
            most = max(map(len, cuts.values()))
            if not most:
                break
            slots = F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*[F.struct(F.lit(j).alias("j"), F.lit(c).alias("c")) for j, c in x]) for i, x in cuts.items() if x for x in (i, x)])
            tests = F.posexplode(F.element_at(slots, F.col("__at"))).alias("slot", "test")
            low = at.select("__at", "features", "label", *(["weight"] if "weight" in df.columns else []), tests).where(F.element_at("features", F.col("test.j") + 1) <= F.col("test.c"))
            below = {(r["__at"], r.slot): np.array(r[2:]) for r in low.groupBy("__at", "slot").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(what)]).collect()}
            next_ = []
            for node in open_:
                best = None
                for slot, (j, c) in enumerate(cuts[node.id]):
                    lo = below.get((node.id, slot))
                    if lo is None or size(lo) <= 0 or size(node.counts - lo) <= 0:
                        continue
                    got = score(node.counts) - (size(lo) * score(lo) + size(node.counts - lo) * score(node.counts - lo)) / size(node.counts)
                    if best is None or got > best[0]:
                        best = (got, j, c, lo)
                if best is None:
                    continue
                node.gain, node.column, node.cut = best[:3]
                node.kids = {0: Node(best[3]), 1: Node(node.counts - best[3])}
                next_ += list(node.kids.values())
            open_ = next_
        return TreeModel(root, read, self.regression)


class ExtraTrees(Learner):
    """Extremely randomised trees, each over all rows with its own seed."""

    def __init__(self, trees: int = 10, depth: int = 6, features: int | None = None, seed: int = 0, regression: bool = False, tries: int = 1) -> None:
        self.trees, self.make, self.regression = trees, lambda i: ExtraTree(depth, features, tries=tries, seed=seed * 1000 + i, regression=regression), regression

    def fit(self, df: DataFrame) -> Model:
        df = _few(df, self.make(0))
        models = [self.make(i).fit(df) for i in range(self.trees)]
        return Mean(models) if self.regression else Vote(models, class_count(df), soft=True)


def prune(model: TreeModel, held_out: DataFrame) -> TreeModel:
    """Reduced-error pruning: a node becomes a leaf where that loses nothing on rows kept apart."""
    k = len(model.root.counts)
    at: dict[int, np.ndarray] = {}
    for r in held_out.withColumn("__leaf", _place(model.root, model.read)).groupBy("__leaf", "label").agg(F.count("*").alias("n")).collect():
        at.setdefault(r["__leaf"], np.zeros(k))[int(r.label)] += r.n

    def walk(node: Node) -> tuple[np.ndarray, float]:
        own = at.get(node.id, np.zeros(k))
        if not node.kids:
            return own, float(own[int(np.argmax(node.counts))])
        seen, right = own.copy(), float(own[int(np.argmax(node.counts))])
        for kid in node.kids.values():
            c, r = walk(kid)
            seen, right = seen + c, right + r
        alone = float(seen[int(np.argmax(node.counts))])
        if alone >= right:
            node.kids, node.column, node.cut = {}, None, None
            return seen, alone
        return seen, right

    walk(model.root)
    return TreeModel(model.root, model.read, model.regression)


def pessimistic_prune(model: TreeModel, z: float = 0.69) -> TreeModel:
    """Error-based pruning: a node becomes a leaf where its upper error estimate is no worse than its leaves'."""

    def upper(counts: np.ndarray) -> float:
        n = counts.sum()
        if n <= 0:
            return 0.0
        f = 1 - counts.max() / n
        return n * (f + z * z / (2 * n) + z * np.sqrt(f / n - f * f / n + z * z / (4 * n * n))) / (1 + z * z / n)

    def walk(node: Node) -> float:
        if not node.kids:
            return upper(node.counts)
        below = sum(walk(kid) for kid in node.kids.values())
        if upper(node.counts) <= below:
            node.kids, node.column, node.cut = {}, None, None
            return upper(node.counts)
        return below

    walk(model.root)
    return TreeModel(model.root, model.read, model.regression)


def importance_by_uses(models: Sequence[TreeModel], weighted: bool = True) -> dict:
    """How often trees test each column; ``weighted`` counts a test by the rows that meet it."""
    out: dict = {}
    for m in models:
        for node in m.root.inner():
            out[node.column] = out.get(node.column, 0.0) + (float(node.counts.sum()) if weighted else 1.0)
    total = sum(out.values()) or 1.0
    return {c: v / total for c, v in out.items()}


def impurity_importance(models: Sequence[TreeModel]) -> dict:
    """Mean decrease of impurity by each column, weighted by rows."""
    out: dict = {}
    for m in models:
        for node in m.root.inner():
            out[node.column] = out.get(node.column, 0.0) + node.gain * float(node.counts.sum()) / max(float(m.root.counts.sum()), 1e-300)
    return {c: v / len(models) for c, v in out.items()}


def _with_feature(j: int, value: Column) -> Column:
    """The features with another value at one place."""
    return F.transform("features", lambda x, i: F.when(i == j, value).otherwise(x))


def permutation_importance(model: Model, df: DataFrame, key: str, seed: int = 0) -> dict[int, float]:
    """Mean decrease of accuracy when one feature's values are dealt to other rows.

    The seeded deal pairs two seeded orders of the rows, so it is a permutation;
    the orders come from blocks, not from one global sort.
    """
    from statloom.models.base import accuracy
    from statloom.operators.dataset import ordered_position
    from statloom.plans.lineage import cut

    base = accuracy(model.transform(df))
    out = {}
    for j in range(dimensions(df)):
        here = ordered_position(df, key, 2 * (seed + j)).withColumnRenamed("__at", "__pos")
        there = ordered_position(df.select(key, F.element_at("features", j + 1).alias("__x")), key, 2 * (seed + j) + 1).select("__x", F.col("__at").alias("__pos"))
        mixed = cut(here.join(there, "__pos"))
        shuffled = mixed.withColumn("features", _with_feature(j, F.col("__x")))
        out[j] = base - accuracy(model.transform(shuffled.drop("__x", "__pos")))
    return out
