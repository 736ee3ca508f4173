"""What learners and models have in common, and the learners of ``pyspark.ml`` behind it.

A training table has ``features`` (array of doubles), ``label`` (double; class
numbers from 0 for classifiers) and, where the learner can use it, ``weight``.
A model adds ``prediction`` and, if it knows them, ``probability``, an array
with one entry a class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.plans.lineage import cut


class Model:
    """Adds ``prediction`` and perhaps ``probability`` to a table with ``features``."""

    def transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class Learner:
    """Fits a model to a table with ``features`` and ``label``."""

    #: Whether rows equal in features and label tell a fit no more than one of them with the sum of their weights.
    sums = False

    def fit(self, df: DataFrame) -> Model:
        raise NotImplementedError


class ColumnModel(Model):
    """A model that is a column expression of the features."""

    def __init__(self, prediction: Callable[[Column], Column], probability: Callable[[Column], Column] | None = None) -> None:
        self.prediction, self.probability = prediction, probability

    def transform(self, df: DataFrame) -> DataFrame:
        x = F.col("features")
        out = df.withColumn("prediction", self.prediction(x).cast("double"))
        return out.withColumn("probability", self.probability(x)) if self.probability else out


class ArrayModel(Model):
    """A model that is a NumPy function of a matrix of features, applied to Arrow batches.

    ``f`` returns one value a row, or with ``classes`` a matrix of class scores
    that are normalised to probabilities.
    """

    def __init__(self, f: Callable[[np.ndarray], np.ndarray], classes: int = 0) -> None:
        self.f, self.classes = f, classes

    def transform(self, df: DataFrame) -> DataFrame:
        f, classes = self.f, self.classes

        @F.pandas_udf("array<double>")
        def scores(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            got = np.asarray(f(np.stack(x.to_numpy()).astype(float)), dtype=float).reshape(len(x), -1)
            if classes:
                total = got.sum(axis=1, keepdims=True)
                got = np.where(total > 0, got / np.where(total > 0, total, 1), 1 / classes)
            return pd.Series(list(got))

        if not classes:
            return df.withColumn("prediction", F.element_at(scores("features"), 1))
        return df.withColumn("probability", scores("features")).withColumn("prediction", arg_max(F.col("probability")))


def arg_max(values: Column) -> Column:
    """Position (from 0) of the largest element, the first of equals, as a double."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("double")


class _Fitted(Model):
    def __init__(self, model) -> None:
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        aside = [c for c in ("prediction", "probability", "rawPrediction", "__vector") if c in df.columns]
        out = self.model.transform(df.drop(*aside).withColumn("__vector", array_to_vector("features")))
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("__vector", "rawPrediction")


#: Rows of a part of a training table, about, that a task of pyspark.ml keeps and reads again each round.
ROWS = 1_000_000


def parted(df: DataFrame) -> DataFrame:
    """``df`` in parts of about ``ROWS`` rows, where there are more of them than cores; else as it is.

    Files are read in parts of like bytes; well compressed ones hold many more rows than memory should.
    """
    parts = -(-df.count() // ROWS)
    return df.repartition(parts) if parts > df.sparkSession.sparkContext.defaultParallelism else df


#: Rows of a training table for each kind of them, at least, for one to stand for its equals.
COPIES = 8


def condensed(df: DataFrame, learners: Sequence[Learner], sums: dict[str, Column], by: dict[str, Column] | None = None) -> DataFrame | None:
    """One row for all of ``df`` that are equal in features, label and the columns ``by``, with the ``sums`` over them, stored.

    None where a learner needs every row, or where few are equal: then the table itself has to serve.
    """
    if not all(one.sums for one in learners):
        return None
    df, keys = df.withColumns(by or {}), ["features", "label", *(by or {})]
    rows, kinds = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*keys))).first()
    if rows < COPIES * kinds:
        return None
    return cut(df.groupBy(*keys).agg(*[F.sum(x).alias(name) for name, x in sums.items()]))


class Ml(Learner):
    """An estimator of ``pyspark.ml`` as a learner; uses ``weight`` if the table has it and the estimator can.

    The estimator is made when it is fitted, since it needs a session and learners are named before there is one.
    """

    def __init__(self, kind: Callable, **params) -> None:
        self.kind, self.params = kind, params
        trees = kind in (C.DecisionTreeClassifier, R.DecisionTreeRegressor) and params.get("minInstancesPerNode", 1) == 1
        self.sums = trees or (kind is C.LogisticRegression and not params.get("regParam"))

    def fit(self, df: DataFrame) -> Model:
        e = self.kind(**self.params)
        e.setFeaturesCol("__vector")
        if e.hasParam("labelCol"):
            e.setLabelCol("label")
        columns = ["label"] if e.hasParam("labelCol") else []
        if e.hasParam("weightCol") and "weight" in df.columns:
            e.setWeightCol("weight")
            columns.append("weight")
        return _Fitted(e.fit(parted(df.select(array_to_vector("features").alias("__vector"), *columns))))


# Classifiers and regressors of pyspark.ml under the names of their families.
def logistic(l2: float = 0.0, l1: float = 0.0, rounds: int = 100) -> Learner:
    """Logistic regression of two or more classes with an elastic-net penalty."""
    total = l1 + l2
    return Ml(C.LogisticRegression, maxIter=rounds, regParam=total, elasticNetParam=l1 / total if total else 0.0)


def linear_svm(penalty: float = 0.01, rounds: int = 100) -> Learner:
    """Linear support vector machine of two classes."""
    return Ml(C.LinearSVC, maxIter=rounds, regParam=penalty)


def decision_tree(depth: int = 5, bins: int = 32, impurity: str = "gini", least: int = 1, seed: int = 1) -> Learner:
    return Ml(C.DecisionTreeClassifier, maxDepth=depth, maxBins=bins, impurity=impurity, minInstancesPerNode=least, seed=seed)


def decision_stump(impurity: str = "gini", bins: int = 32) -> Learner:
    return decision_tree(depth=1, bins=bins, impurity=impurity)


def random_forest(trees: int = 50, depth: int = 8, share: float = 1.0, features: str = "auto", seed: int = 1) -> Learner:
    return Ml(C.RandomForestClassifier, numTrees=trees, maxDepth=depth, subsamplingRate=share, featureSubsetStrategy=features, seed=seed)


def boosted_trees(rounds: int = 20, depth: int = 3, rate: float = 0.1, share: float = 1.0, seed: int = 1) -> Learner:
    """Gradient boosted trees for two classes."""
    return Ml(C.GBTClassifier, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)


def perceptron_net(layers: Sequence[int], rounds: int = 100, seed: int = 1) -> Learner:
    """Feed-forward network with sigmoid hidden layers and a softmax output."""
    return Ml(C.MultilayerPerceptronClassifier, layers=list(layers), maxIter=rounds, seed=seed)


def regression_tree(depth: int = 5, bins: int = 32, least: int = 1, seed: int = 1) -> Learner:
    return Ml(R.DecisionTreeRegressor, maxDepth=depth, maxBins=bins, minInstancesPerNode=least, seed=seed)


def regression_forest(trees: int = 50, depth: int = 8, share: float = 1.0, seed: int = 1) -> Learner:
    return Ml(R.RandomForestRegressor, numTrees=trees, maxDepth=depth, subsamplingRate=share, seed=seed)


def stochastic_gradient_boosting(rounds: int = 20, depth: int = 3, rate: float = 0.1, share: float = 0.5, seed: int = 1) -> Learner:
    """Boosted regression trees, each fitted to a share of the rows."""
    return Ml(R.GBTRegressor, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, seed=seed)


def elastic_net(l1: float = 0.0, l2: float = 0.0, rounds: int = 100) -> Learner:
    total = l1 + l2
    return Ml(R.LinearRegression, maxIter=rounds, regParam=total, elasticNetParam=l1 / total if total else 0.0)


def fold_of(key: Column, folds: int, seed: int = 0) -> Column:
    """A fold number that depends on the row's key and the seed only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def accuracy(predicted: DataFrame) -> float:
    """Weighted share of right predictions."""
    w = F.col("weight") if "weight" in predicted.columns else F.lit(1.0)
    right = F.when(F.col("prediction") == F.col("label"), w).otherwise(0.0)
    return float(predicted.agg(F.sum(right) / F.sum(w)).first()[0] or 0.0)


def rmse(predicted: DataFrame) -> float:
    e = F.col("prediction") - F.col("label")
    return float(predicted.agg(F.sqrt(F.avg(e * e))).first()[0] or 0.0)


def cross_validate(learner: Learner, df: DataFrame, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """``df`` with ``fold`` and the prediction of the model that was fitted to all other folds."""
    dealt = df.withColumn("fold", fold_of(F.col(key), folds, seed))
    parts = [learner.fit(dealt.where(F.col("fold") != i)).transform(dealt.where(F.col("fold") == i)) for i in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def class_count(df: DataFrame) -> int:
    """Classes of a labelled table: one more than the largest class number."""
    return int(df.agg(F.max("label")).first()[0] or 0) + 1


def dimensions(df: DataFrame) -> int:
    row = df.select(F.size("features")).first()
    return int(row[0]) if row else 0
