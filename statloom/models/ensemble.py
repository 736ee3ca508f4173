"""Ensembles, reductions of classes, calibration and model search over any learners."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import regression as R
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.models.base import ColumnModel, Learner, Model, accuracy, arg_max, class_count, condensed, cross_validate, fold_of, rmse
from statloom.plans.lineage import cut

_OWN = ("prediction", "probability")


def _with(models: Sequence[Model], df: DataFrame) -> DataFrame:
    """``df`` with ``__p<i>`` and, where known, ``__q<i>`` of every model."""
    out = df.drop(*_OWN)
    for i, m in enumerate(models):
        out = m.transform(out).withColumnRenamed("prediction", f"__p{i}").withColumnRenamed("probability", f"__q{i}")
    return out


def _clean(df: DataFrame, n: int) -> DataFrame:
    return df.drop(*[f"__{k}{i}" for i in range(n) for k in "pq"])


def _total(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


class Vote(Model):
    """Weighted votes of models for classes; with ``soft`` they share their vote by probability."""

    def __init__(self, models: Sequence[Model], classes: int, weights: Sequence[float] | None = None, soft: bool = False) -> None:
        self.models, self.classes, self.weights, self.soft = list(models), classes, list(weights or [1.0] * len(models)), soft

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        soft = lambda i, k: F.element_at(f"__q{i}", k + 1) if self.soft and f"__q{i}" in out.columns else (F.col(f"__p{i}") == k).cast("double")
        votes = [_total([w * soft(i, k) for i, w in enumerate(self.weights)]) for k in range(self.classes)]
        all_ = _total(votes)
        out = out.withColumn("probability", F.array(*[F.when(all_ > 0, v / all_).otherwise(1.0 / self.classes) for v in votes]))
        return _clean(out.withColumn("prediction", arg_max(F.col("probability"))), len(self.models))


class Mean(Model):
    """Weighted mean of regression models."""

    def __init__(self, models: Sequence[Model], weights: Sequence[float] | None = None) -> None:
        self.models, self.weights = list(models), list(weights or [1.0] * len(models))

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        value = _total([w * F.col(f"__p{i}") for i, w in enumerate(self.weights)]) / float(sum(self.weights))
        return _clean(out.withColumn("prediction", value), len(self.models))


class MajorityVote(Learner):
    """Every learner is fitted to all rows; their models vote."""

    def __init__(self, learners: Sequence[Learner], soft: bool = False) -> None:
        self.learners, self.soft = learners, soft

    def fit(self, df: DataFrame) -> Model:
        return Vote([one.fit(df) for one in self.learners], class_count(df), soft=self.soft)


class AveragedRegressor(Learner):
    def __init__(self, learners: Sequence[Learner]) -> None:
        self.learners = learners

    def fit(self, df: DataFrame) -> Model:
        return Mean([one.fit(df) for one in self.learners])


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1.0)


def _weighted(df: DataFrame, factor: Column) -> DataFrame:
    return df.withColumn("weight", _weight(df) * factor)


def _few(df: DataFrame, learner: Learner) -> DataFrame:
    """``df`` with its equal rows as one, where the learner allows it and there are enough of them."""
    few = condensed(df, [learner], {"weight": _weight(df)})
    return df if few is None else few


def _poisson(u: Column) -> Column:
    """A Poisson number of mean one from a uniform one: how often a bootstrap sample holds a row."""
    out, p, total = F.lit(0.0), math.exp(-1), 0.0
    for k in range(12):
        total += p
        out = F.when(u >= total, float(k + 1)).otherwise(out)
        p /= k + 1
    return out


class Bagging(Learner):
    """Models of bootstrap samples, each a Poisson weight a row from its key and the seed.

    Where equal rows are many, the weights of all rounds are added up in one aggregation.
    """

    def __init__(self, learner: Learner, rounds: int = 10, key: str = "id", seed: int = 0, soft: bool = True, regression: bool = False) -> None:
        self.learner, self.rounds, self.key, self.seed, self.soft, self.regression = learner, rounds, key, seed, soft, regression

    def factor(self, i: int) -> Column:
        return _poisson(F.pmod(F.xxhash64(self.key, F.lit(self.seed), F.lit(i)), F.lit(1 << 40)) / float(1 << 40))

    def fit(self, df: DataFrame) -> Model:
        few = condensed(df, [self.learner], {f"__w{i}": _weight(df) * self.factor(i) for i in range(self.rounds)})
        drawn = lambda i: _weighted(df, self.factor(i)) if few is None else few.withColumn("weight", F.col(f"__w{i}"))
        models = [self.learner.fit(drawn(i).where("weight > 0")) for i in range(self.rounds)]
        return Mean(models) if self.regression else Vote(models, class_count(df if few is None else few), soft=self.soft)


class Wagging(Bagging):
    """Like bagging, with weights drawn from a normal distribution around one, never below zero."""

    def __init__(self, learner: Learner, rounds: int = 10, key: str = "id", seed: int = 0, sd: float = 2.0, **more) -> None:
        super().__init__(learner, rounds, key, seed, **more)
        self.sd = sd

    def factor(self, i: int) -> Column:
        u = [F.pmod(F.xxhash64(self.key, F.lit(self.seed), F.lit(i), F.lit(j)), F.lit(1 << 40)) / float(1 << 40) for j in range(12)]
        return F.greatest(F.lit(0.0), 1 + self.sd * (_total(u) - 6))


class AdaBoost(Learner):
    """Boosting by reweighting (AdaBoost.M1; with ``samme`` for weak learners of many classes).

    Weights are a column, normalised each round in one aggregation; the table
    with new weights is stored, so no round computes earlier ones again.
    """

    def __init__(self, learner: Learner, rounds: int = 10, samme: bool = False) -> None:
        self.learner, self.rounds, self.samme = learner, rounds, samme

    def fit(self, df: DataFrame) -> Model:
        df = _few(df, self.learner)
        classes = class_count(df)
        now = _weighted(df, F.lit(1.0))
        models, alphas = [], []
        for _ in range(self.rounds):
            model = self.learner.fit(now)
            seen = model.transform(now.drop(*_OWN))
            wrong = (F.col("prediction") != F.col("label")).cast("double")
            bad, total = seen.agg(F.sum(F.col("weight") * wrong), F.sum("weight")).first()
            error = (bad or 0.0) / total
            if error <= 0:
                models, alphas = [*models, model], [*alphas, 10.0]
                break
            extra = math.log(classes - 1) if self.samme and classes > 1 else 0.0
            alpha = math.log((1 - error) / error) + extra
            if alpha <= 0:
                break
            models, alphas = [*models, model], [*alphas, alpha]
            now = cut(seen.withColumn("weight", F.col("weight") * F.exp(alpha * wrong) / F.lit(total)).select(now.columns))
        return Vote(models, classes, alphas) if models else Vote([self.learner.fit(df)], classes)


class ArcX4(Learner):
    """Arcing: a row's weight is one plus the fourth power of its misses so far."""

    def __init__(self, learner: Learner, rounds: int = 10) -> None:
        self.learner, self.rounds = learner, rounds

    def fit(self, df: DataFrame) -> Model:
        df = _few(df, self.learner)
        now, models = df.withColumn("__missed", F.lit(0.0)), []
        for _ in range(self.rounds):
            model = self.learner.fit(_weighted(now, 1 + F.pow("__missed", F.lit(4.0))))
            models.append(model)
            seen = model.transform(now.drop(*_OWN))
            now = cut(seen.withColumn("__missed", F.col("__missed") + (F.col("prediction") != F.col("label")).cast("double")).select(now.columns))
        return Vote(models, class_count(df))


class _Margin(Model):
    """Two classes by the sign of a sum of values that models give to regions of their prediction."""

    def __init__(self, models: Sequence[Model], values: Sequence[tuple[float, float]]) -> None:
        self.models, self.values = list(models), list(values)

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        f = _total([F.when(F.col(f"__p{i}") == 1, hi).otherwise(lo) for i, (lo, hi) in enumerate(self.values)])
        p = 1 / (1 + F.exp(-2 * f))
        out = out.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (f > 0).cast("double"))
        return _clean(out, len(self.models))


class ModestAdaBoost(Learner):
    """Two classes: a round counts for what it knows on hard rows and not on easy ones."""

    def __init__(self, learner: Learner, rounds: int = 10) -> None:
        self.learner, self.rounds = learner, rounds

    def fit(self, df: DataFrame) -> Model:
        now = cut(df.withColumn("weight", F.lit(1.0)).withColumn("__f", F.lit(0.0)))
        models, values = [], []
        for _ in range(self.rounds):
            total, n = now.agg(F.sum("weight"), F.count("*")).first()
            now = now.withColumn("weight", F.col("weight") / total)
            model = self.learner.fit(now)
            seen = model.transform(now.drop(*_OWN))
            most = seen.agg(F.max("weight")).first()[0]
            easy = (most - F.col("weight") + 1e-12) / (n * most - 1 + n * 1e-12)
            sums = {(int(r.prediction), int(r.label)): (r.d, r.e) for r in seen.groupBy("prediction", "label").agg(F.sum("weight").alias("d"), F.sum(easy).alias("e")).collect()}
            part = lambda p, y: sums.get((p, y), (0.0, 0.0))  # noqa: E731, B023
            lo, hi = (part(p, 1)[0] * (1 - part(p, 1)[1]) - part(p, 0)[0] * (1 - part(p, 0)[1]) for p in (0, 1))
            if lo == 0 and hi == 0:
                break
            models, values = [*models, model], [*values, (lo, hi)]
            f = F.when(F.col("prediction") == 1, hi).otherwise(lo)
            now = cut(seen.withColumn("__f", F.col("__f") + f).withColumn("weight", F.exp(-(2 * F.col("label") - 1) * F.col("__f"))).select(now.columns))
        return _Margin(models, values)


class EmphasisBoost(Learner):
    """Two classes: weights mix how wrong and how near the border a row is, by ``mix``."""

    def __init__(self, learner: Learner, rounds: int = 10, mix: float = 0.35) -> None:
        self.learner, self.rounds, self.mix = learner, rounds, mix

    def fit(self, df: DataFrame) -> Model:
        y = 2 * F.col("label") - 1
        now = cut(df.withColumn("weight", F.lit(1.0)).withColumn("__f", F.lit(0.0)))
        models, values = [], []
        for _ in range(self.rounds):
            model = self.learner.fit(now)
            h = 2 * F.col("prediction") - 1
            seen = model.transform(now.drop(*_OWN))
            edge = seen.agg(F.sum(F.col("weight") * h * y) / F.sum("weight")).first()[0]
            if edge <= 0:
                break
            alpha = 0.5 * math.log((1 + edge) / max(1 - edge, 1e-10))
            models, values = [*models, model], [*values, (-alpha, alpha)]
            f = F.col("__f") + alpha * h
            weight = F.exp(self.mix * F.pow(f - y, F.lit(2.0)) - (1 - self.mix) * f * f)
            now = cut(seen.withColumn("weight", weight).withColumn("__f", f).select(now.columns))
            if edge >= 1 - 1e-10:
                break
        return _Margin(models, values) if models else _Margin([self.learner.fit(df)], [(-1.0, 1.0)])


class _Additive(Model):
    def __init__(self, models: Sequence[Model], rate: float) -> None:
        self.models, self.rate = list(models), rate

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        f = _total([self.rate * F.col(f"__p{i}") for i in range(len(self.models))])
        p = 1 / (1 + F.exp(-2 * f))
        out = out.withColumn("probability", F.array(1 - p, p)).withColumn("prediction", (f > 0).cast("double"))
        return _clean(out, len(self.models))


class LogitBoost(Learner):
    """Two classes: regressors of the working response, added up."""

    def __init__(self, regressor: Learner, rounds: int = 10, most: float = 3.0) -> None:
        self.regressor, self.rounds, self.most = regressor, rounds, most

    def fit(self, df: DataFrame) -> Model:
        few = condensed(df, [self.regressor], {"__n": F.lit(1.0)})
        now = cut((df.withColumn("__n", F.lit(1.0)) if few is None else few).withColumn("__f", F.lit(0.0)).withColumn("__y", F.col("label")))
        models = []
        for _ in range(self.rounds):
            p = 1 / (1 + F.exp(-2 * F.col("__f")))
            w = F.greatest(p * (1 - p), F.lit(1e-8))
            z = F.greatest(F.least((F.col("__y") - p) / w, F.lit(self.most)), F.lit(-self.most))
            model = self.regressor.fit(now.withColumn("label", z).withColumn("weight", F.col("__n") * w))
            models.append(model)
            now = cut(model.transform(now.drop(*_OWN)).withColumn("__f", F.col("__f") + 0.5 * F.col("prediction")).select(now.columns))
        return _Additive(models, 0.5)


class _Stacked(Model):
    def __init__(self, models: Sequence[Model], top: Model, classes: int) -> None:
        self.models, self.top, self.classes = list(models), top, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out = _meta(_with(self.models, df), len(self.models), self.classes)
        done = self.top.transform(out.withColumnRenamed("features", "__own").withColumnRenamed("__meta", "features"))
        return _clean(done.drop("features").withColumnRenamed("__own", "features"), len(self.models))


def _meta(df: DataFrame, n: int, classes: int) -> DataFrame:
    """``__meta``: the base models' predictions as features; classes one by one."""
    xs = []
    for i in range(n):
        if classes and f"__q{i}" in df.columns:
            xs += [F.element_at(f"__q{i}", k + 1) for k in range(classes)]
        elif classes:
            xs += [(F.col(f"__p{i}") == k).cast("double") for k in range(classes)]
        else:
            xs.append(F.col(f"__p{i}"))
    return df.withColumn("__meta", F.array(*xs))


class Stacking(Learner):
    """A learner on top of the predictions that others make for rows they were not fitted to."""

    def __init__(self, learners: Sequence[Learner], top: Learner, key: str = "id", folds: int = 3, regression: bool = False) -> None:
        self.learners, self.top, self.key, self.folds, self.regression = learners, top, key, folds, regression

    def fit(self, df: DataFrame) -> Model:
        classes = 0 if self.regression else class_count(df)
        fold = fold_of(F.col(self.key), self.folds)
        few = condensed(df, [*self.learners, self.top], {"weight": _weight(df), "__n": F.lit(1.0)}, {"__fold": fold})
        dealt, parts = df.withColumn("__fold", fold) if few is None else few, None
        seen = [] if few is None else [F.col("__n").alias("weight")]  # to the learner on top rows count alike
        for i in range(self.folds):
            rest = dealt.where(F.col("__fold") != i)
            one = _meta(_with([x.fit(rest) for x in self.learners], dealt.where(F.col("__fold") == i)), len(self.learners), classes).select(F.col("__meta").alias("features"), "label", *seen)
            parts = one if parts is None else parts.unionByName(one)
        return _Stacked([x.fit(df if few is None else few) for x in self.learners], self.top.fit(cut(parts)), classes)


def _score(df: DataFrame) -> Column:
    """How sure a two-class model is of class 1."""
    return F.element_at("probability", 2) if "probability" in df.columns else F.col("prediction")


class _OneVsAll(Model):
    def __init__(self, models: Sequence[Model]) -> None:
        self.models = list(models)

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        score = [F.element_at(f"__q{i}", 2) if f"__q{i}" in out.columns else F.col(f"__p{i}") for i in range(len(self.models))]
        all_ = _total(score)
        out = out.withColumn("probability", F.array(*[F.when(all_ > 0, s / all_).otherwise(1.0 / len(score)) for s in score]))
        return _clean(out.withColumn("prediction", arg_max(F.col("probability"))), len(self.models))


class OneVsAll(Learner):
    """Many classes by one two-class model a class."""

    def __init__(self, learner: Learner) -> None:
        self.learner = learner

    def fit(self, df: DataFrame) -> Model:
        return _OneVsAll([self.learner.fit(df.withColumn("label", (F.col("label") == k).cast("double"))) for k in range(class_count(df))])


class _Pairs(Model):
    def __init__(self, models: Mapping[tuple[int, int], Model], classes: int, path: bool) -> None:
        self.pairs, self.models, self.classes, self.path = list(models), list(models.values()), classes, path

    def transform(self, df: DataFrame) -> DataFrame:
        out = _with(self.models, df)
        if self.path:  # each step asks one model and strikes out one class
            low, high = F.lit(0), F.lit(self.classes - 1)
            answers = F.map_from_arrays(F.array(*[F.lit(a * self.classes + b) for a, b in self.pairs]), F.array(*[F.col(f"__p{i}") for i in range(len(self.pairs))]))
            at = F.struct(low.alias("a"), high.alias("b"))
            step = lambda s, _: F.when(F.element_at(answers, s["a"] * self.classes + s["b"]) == 1, F.struct((s["a"] + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), (s["b"] - 1).alias("b")))
            end = F.aggregate(F.sequence(F.lit(1), F.lit(self.classes - 1)), at, step) if self.classes > 1 else at
            return _clean(out.withColumn("prediction", end["a"].cast("double")), len(self.models))
        votes = []
        for k in range(self.classes):
            mine = [(F.col(f"__p{i}") == (0 if a == k else 1)).cast("double") for i, (a, b) in enumerate(self.pairs) if k in (a, b)]
            votes.append(_total(mine) / len(self.pairs) if mine else F.lit(1.0))
        out = out.withColumn("probability", F.array(*votes))
        return _clean(out.withColumn("prediction", arg_max(F.col("probability"))), len(self.models))


class OneVsOne(Learner):
    """Many classes by a model for each pair of classes: by votes, or with ``path`` along a decision graph."""

    def __init__(self, learner: Learner, path: bool = False) -> None:
        self.learner, self.path = learner, path

    def fit(self, df: DataFrame) -> Model:
        n, models = class_count(df), {}
        for a, b in itertools.combinations(range(n), 2):
            models[a, b] = self.learner.fit(df.where(F.col("label").isin(float(a), float(b))).withColumn("label", (F.col("label") == b).cast("double")))
        return _Pairs(models, n, self.path)


class _Signed(Model):
    def __init__(self, model: Model) -> None:
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", (F.col("prediction") > 0).cast("double"))


class RegressorToClassifier(Learner):
    """Two classes as -1 and 1 for a regressor; the sign decides."""

    def __init__(self, regressor: Learner) -> None:
        self.regressor = regressor

    def fit(self, df: DataFrame) -> Model:
        return _Signed(self.regressor.fit(df.withColumn("label", 2 * F.col("label") - 1)))


class PriorClassifier(Learner):
    """The weighted class shares, whatever the features."""

    def fit(self, df: DataFrame) -> Model:
        w = F.col("weight") if "weight" in df.columns else F.lit(1.0)
        sums = {int(r.label): r.w for r in df.groupBy("label").agg(F.sum(w).alias("w")).collect()}
        total = sum(sums.values()) or 1.0
        shares = F.array(*[F.lit(sums.get(k, 0.0) / total) for k in range(max(sums, default=0) + 1)])
        return ColumnModel(lambda _: arg_max(shares), lambda _: shares)


def platt_fit(scored: DataFrame, rounds: int = 50) -> tuple[float, float]:
    """``a, b`` of 1 / (1 + exp(a * score + b)) by Newton steps, one aggregation each (``score``, ``label`` 0/1)."""
    pos, neg = scored.agg(F.sum((F.col("label") == 1).cast("double")), F.sum((F.col("label") == 0).cast("double"))).first()
    pos, neg = pos or 0.0, neg or 0.0
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 0.0, math.log((neg + 1) / (pos + 1))
    s, t = F.col("score"), F.when(F.col("label") == 1, high).otherwise(low)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(a * s + b))
        d, v = t - p, p * (1 - p)
        g1, g2, h11, h12, h22 = scored.agg(F.sum(s * d), F.sum(d), F.sum(s * s * v), F.sum(s * v), F.sum(v)).first()
        h11, h22 = h11 + 1e-12, h22 + 1e-12
        det = h11 * h22 - h12 * h12
        da, db = -(h22 * g1 - h12 * g2) / det, -(h11 * g2 - h12 * g1) / det
        a, b = a + da, b + db
        if abs(da) < 1e-10 * (1 + abs(a)) and abs(db) < 1e-10 * (1 + abs(b)):
            break
    return a, b


class _Calibrated(Model):
    def __init__(self, model: Model, chance: Callable[[DataFrame], DataFrame]) -> None:
        self.model, self.chance = model, chance

    def transform(self, df: DataFrame) -> DataFrame:
        seen = self.model.transform(df)
        out = self.chance(seen.withColumn("score", _score(seen)))
        out = out.withColumn("probability", F.array(1 - F.col("__chance"), F.col("__chance"))).drop("__chance", "score")
        return out.withColumn("prediction", (F.element_at("probability", 2) > 0.5).cast("double"))


class Calibrated(Learner):
    """Two-class probabilities from scores: ``platt`` or ``isotonic``.

    ``mode`` says what the scores come from: "naive" the rows of the fit, "cv"
    models that did not see them, "hold_out" a share of the rows kept apart.
    """

    def __init__(self, learner: Learner, method: str = "platt", mode: str = "cv", key: str = "id", folds: int = 3, share: float = 0.3) -> None:
        self.learner, self.method, self.mode, self.key, self.folds, self.share = learner, method, mode, key, folds, share

    def fit(self, df: DataFrame) -> Model:
        if self.mode == "cv":
            seen, model = cross_validate(self.learner, df, self.key, self.folds), self.learner.fit(df)
        elif self.mode == "hold_out":
            apart = fold_of(F.col(self.key), 1000) < int(1000 * self.share)
            model = self.learner.fit(df.where(~apart))
            seen = model.transform(df.where(apart))
        else:
            model = self.learner.fit(df)
            seen = model.transform(df)
        scored = cut(seen.select(_score(seen).alias("score"), "label"))
        if self.method == "platt":
            a, b = platt_fit(scored)
            return _Calibrated(model, lambda x: x.withColumn("__chance", 1 / (1 + F.exp(a * F.col("score") + b))))
        steps = R.IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="__chance").fit(scored)
        return _Calibrated(model, steps.transform)


def search(make: Callable[..., Learner], candidates: Sequence[Mapping], df: DataFrame, key: str = "id", folds: int = 3, regression: bool = False) -> list[tuple[float, dict]]:
    """Cross-validated score of every candidate's parameters, the best first (accuracy, or minus the root mean square error)."""
    held = cut(df)
    out = []
    for params in candidates:
        seen = cross_validate(make(**params), held, key, folds)
        out.append((-rmse(seen) if regression else accuracy(seen), dict(params)))
    return sorted(out, key=lambda x: -x[0])


def grid(**choices: Sequence) -> list[dict]:
    """All combinations of the choices."""
    return [dict(zip(choices, xs)) for xs in itertools.product(*choices.values())]


def random_choices(n: int, seed: int = 0, **choices: Sequence | Callable[[float], float]) -> list[dict]:
    """``n`` seeded combinations; a callable maps a uniform number to a value (say a quantile function)."""
    rnd = random.Random(seed)
    return [{k: c(rnd.random()) if callable(c) else rnd.choice(list(c)) for k, c in choices.items()} for _ in range(n)]


class Search(Learner):
    """A learner whose parameters are chosen by cross validation, then fitted to all rows."""

    def __init__(self, make: Callable[..., Learner], candidates: Sequence[Mapping], key: str = "id", folds: int = 3, regression: bool = False) -> None:
        self.make, self.candidates, self.key, self.folds, self.regression = make, candidates, key, folds, regression

    def fit(self, df: DataFrame) -> Model:
        self.tried = search(self.make, self.candidates, df, self.key, self.folds, self.regression)
        return self.make(**self.tried[0][1]).fit(df)
