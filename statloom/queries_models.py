"""Queries that fit models of ``pyspark.ml`` and report how they do."""

from __future__ import annotations

from pyspark.ml import clustering as K
from pyspark.ml import feature as P
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.models import base as B
from statloom.models.bayes import GaussianNaiveBayes
from statloom.registry import query, table


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line prices with three numbers to predict them from."""
    x = table(spark, sf_dir, "lineitem")
    numbers = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    return x.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), numbers.alias("features"), (F.col("l_extendedprice") / 1000).alias("label"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return x.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))


def _held_out(x: DataFrame, learner: B.Learner) -> DataFrame:
    """Predictions for a fifth of the rows by a model of the others."""
    fold = B.fold_of(F.col("id"), 5)
    return learner.fit(x.where(fold > 0)).transform(x.where(fold == 0))


def _classifier(name: str, learner: B.Learner, binary: bool = True) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if binary:
            x = _numbers(spark, sf_dir).withColumn("label", (F.col("label") > 30).cast("double"))
        else:
            x = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), vector_to_array("features").alias("features"), "label")
        seen = _held_out(x, learner)
        return seen.agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))

    run.__name__ = name
    query()(run)


def _regressor(name: str, learner: B.Learner) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = F.col("prediction") - F.col("label")
        return _held_out(_numbers(spark, sf_dir), learner).agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))

    run.__name__ = name
    query()(run)


_classifier("logistic_regression", B.logistic(rounds=20))
_classifier("linear_svc", B.linear_svm(0.0, rounds=10))
_classifier("decision_tree", B.decision_tree(4))
_classifier("random_forest", B.random_forest(10, 4))
_classifier("boosted_trees", B.boosted_trees(5, 3))
_classifier("gaussian_naive_bayes", GaussianNaiveBayes(), binary=False)
_classifier("neural_network", B.perceptron_net([64, 16, 10], 10), binary=False)
_regressor("ridge_regression", B.elastic_net(l2=0.1))
_regressor("lasso_regression", B.elastic_net(l1=0.1))
_regressor("tree_regression", B.regression_tree(4))


@query("""WITH s AS (SELECT count(*) n, var_pop(y) yy, covar_pop(y,a) ya, covar_pop(y,b) yb, var_pop(a) aa, var_pop(b) bb, covar_pop(a,b) ab FROM (SELECT l_extendedprice/1000 y, l_quantity a, l_discount b FROM lineitem))
 SELECT n, round(sqrt(yy - (ya*(ya*bb-yb*ab) + yb*(yb*aa-ya*ab))/(aa*bb-ab*ab)),5) rmse FROM s""")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of least squares with two features on the rows of the fit."""
    x = _numbers(spark, sf_dir).withColumn("features", F.slice("features", 1, 2))
    e = F.col("prediction") - F.col("label")
    return B.elastic_net().fit(x).transform(x).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse"))


@query()
def isotonic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the best rising steps of price over quantity."""
    x = _numbers(spark, sf_dir).select(F.element_at("features", 1).alias("features"), "label")
    e = F.col("prediction") - F.col("label")
    return R.IsotonicRegression().fit(x).transform(x).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    return K.KMeans(k=10, seed=1, maxIter=10).fit(x).transform(x).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def gaussian_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the vectors, all dimensions, by three components with a variance for each dimension."""
    from statloom.operators.clustering import gaussian_mixture as fit
    from statloom.operators.clustering import mixture_assign

    x = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), vector_to_array("features").alias("vec"))
    return mixture_assign(x, fit(x, 3, rounds=10)).select(F.col("id").alias("vec_id"), "cluster")


@query()
def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    m = P.PCA(k=3, inputCol="features", outputCol="low").fit(x)
    return m.transform(x).select("vec_id", vector_to_array("low").alias("low"))


@query()
def topic_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics over every token, hashed into 2^18 columns; colliding tokens add up."""
    from statloom.functions.text import tokens

    x = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("words"))
    counted = P.HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 18).transform(x)
    m = K.LDA(k=4, maxIter=5, seed=1).fit(counted)
    return m.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("topics"))
