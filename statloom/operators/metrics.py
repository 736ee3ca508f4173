"""Evaluation metrics from mergeable counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.operators.stats import prefix_sums


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """``label, predicted, n``."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def binary_scores(df: DataFrame, label: str, predicted: str, beta: float = 2.0, digits: int = 9) -> DataFrame:
    """``metric, value`` of 0/1 predictions; class 0 is the positive class."""
    c = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("double"))
    n = df.agg(c(0, 0).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(1, 1).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (total * total)
    accuracy = (tp + tn) / total
    b2 = beta * beta
    values = {
        "accuracy": accuracy,
        "balanced_accuracy": (tp / (tp + fn) + tn / (tn + fp)) / 2,
        "precision": tp / (tp + fp),
        "recall": tp / (tp + fn),
        "f1": 2 * tp / (2 * tp + fp + fn),
        "fbeta": (1 + b2) * tp / ((1 + b2) * tp + b2 * fn + fp),
        "mcc": (tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)),
        "kappa": (accuracy - chance) / (1 - chance),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, digits).alias("value")) for k, v in values.items()])
    return n.select(F.explode(rows).alias("x")).select("x.*")


def log_loss(df: DataFrame, label: str, probability: str, digits: int = 9) -> DataFrame:
    """``log_loss`` of probabilities of label 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-15)), F.lit(1 - 1e-15))
    return df.agg(F.round(F.avg(F.when(F.col(label) == 1, -F.log(p)).otherwise(-F.log(1 - p))), digits).alias("log_loss"))


def auc(df: DataFrame, label: str, score: str, weight: str | None = None, digits: int = 9) -> DataFrame:
    """``auc``: weighted, ties count half; scores are added up first, then summed in order."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pos = F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("p")
    neg = F.sum(F.when(F.col(label) == 1, F.lit(0.0)).otherwise(w)).alias("q")
    by_score = df.groupBy(F.col(score).alias("s")).agg(pos, neg)
    run = prefix_sums(by_score, "s", ["q"])
    area = F.sum(F.col("p") * (F.col("upto_q") - F.col("q") / 2))
    return run.agg(F.round(area / (F.sum("p") * F.sum("q")), digits).alias("auc"))


def regression_scores(df: DataFrame, truth: str, predicted: str, digits: int = 6) -> DataFrame:
    """``metric, value``: mae, mse, rmse, rmsle-free relative errors and r2, in two aggregations."""
    y, p = F.col(truth), F.col(predicted)
    mean = df.agg(F.avg(y).alias("__m"))
    e = df.join(F.broadcast(mean))
    sums = e.agg(
        F.avg(F.abs(y - p)).alias("mae"), F.avg((y - p) * (y - p)).alias("mse"),
        F.sum(F.abs(y - p)).alias("a"), F.sum(F.abs(y - F.col("__m"))).alias("b"),
        F.sum((y - p) * (y - p)).alias("c"), F.sum((y - F.col("__m")) * (y - F.col("__m"))).alias("d"),
    )
    values = {"mae": F.col("mae"), "mse": F.col("mse"), "rmse": F.sqrt("mse"), "rae": F.col("a") / F.col("b"), "rse": F.col("c") / F.col("d"), "r2": 1 - F.col("c") / F.col("d")}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, digits).alias("value")) for k, v in values.items()])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def cluster_agreement(df: DataFrame, label: str, cluster: str, digits: int = 9) -> DataFrame:
    """``metric, value``: adjusted Rand, NMI, homogeneity, completeness, V, from one contingency table."""
    cell = df.groupBy(F.col(label).alias("l"), F.col(cluster).alias("c")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda x: x * (x - 1) / 2
    total = cell.agg(F.sum("n").alias("t"))  # one row
    marked = cell.join(F.broadcast(total)).select("l", "c", "n", "t", F.sum("n").over(W.partitionBy("l")).alias("a"), F.sum("n").over(W.partitionBy("c")).alias("b"))
    n, a, b, t = (F.col(x) for x in "nabt")
    sums = marked.agg(
        F.sum(pairs(n)).alias("i"),
        F.sum(n / a * pairs(a)).alias("x"), F.sum(n / b * pairs(b)).alias("y"), F.first("t").alias("t"),
        F.sum(n / t * F.log(n * t / (a * b))).alias("mi"),
        (-F.sum(n / t * F.log(a / t))).alias("hl"), (-F.sum(n / t * F.log(b / t))).alias("hc"),
    )
    i, x, y, mi, hl, hc = (F.col(k) for k in ("i", "x", "y", "mi", "hl", "hc"))
    expected = x * y / pairs(F.col("t"))
    h, c = mi / hl, mi / hc
    values = {"ari": (i - expected) / ((x + y) / 2 - expected), "nmi": 2 * mi / (hl + hc), "homogeneity": h, "completeness": c, "v_measure": 2 * h * c / (h + c)}
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, digits).alias("value")) for k, v in values.items()])
    return sums.select(F.explode(rows).alias("x")).select("x.*")
