"""Tests of hypotheses with p-values: t, z and Kolmogorov-Smirnov, one aggregation each before the p-value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions.distributions import Distribution, Kolmogorov, Normal
from statloom.functions.numeric import beta_inc
from statloom.functions.special import column
from statloom.operators.stats import prefix_sums

ALTERNATIVES = ("not_equal", "less", "greater")


def _t_cdf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    tail = 0.5 * beta_inc(df / (df + t * t), df / 2, 0.5)
    return np.where(t < 0, tail, 1 - tail)


def _p(cdf, statistic: Column, alternative: str) -> Column:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative is one of {ALTERNATIVES}")
    if alternative == "less":
        return cdf(statistic)
    return 2 * cdf(-F.abs(statistic)) if alternative == "not_equal" else cdf(-statistic)


def t_test(df: DataFrame, value: str, mean: float, by: Sequence[str] = (), alternative: str = "not_equal") -> DataFrame:
    """``*by, n, statistic, p_value`` of the one-sample t test (population deviation).

    Nulls are no samples; a group of fewer than two, or without spread, has null.
    """
    x = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    made = agg.withColumn("statistic", F.when((F.col("n") > 1) & (F.col("s") > 0), (F.col("m") - mean) * F.sqrt(F.col("n").cast("double")) / F.col("s")))
    p = _p(lambda t: column(_t_cdf, t, F.col("n") - 1), F.col("statistic"), alternative)
    return made.select(*by, "n", "statistic", p.alias("p_value"))


def z_test(df: DataFrame, value: str, mean: float, sd: float, by: Sequence[str] = (), alternative: str = "not_equal") -> DataFrame:
    """``*by, n, statistic, p_value`` of the z test with a known deviation."""
    x = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"))
    made = agg.withColumn("statistic", (F.col("m") - mean) * F.sqrt(F.col("n").cast("double")) / sd)
    return made.select(*by, "n", "statistic", _p(lambda z: Normal().column("cdf", z), F.col("statistic"), alternative).alias("p_value"))


def _ks_p(n: Column, d: Column) -> Column:
    root = F.sqrt(n)
    return Kolmogorov().column("survival", (root + 0.12 + 0.11 / root) * d)


def ks_one_sample(df: DataFrame, value: str, dist: Distribution) -> DataFrame:
    """``n, d, p_value``: the two-sided distance of a sample from a distribution.

    Values are counted first; the running count is a range-partitioned prefix
    sum, so no task holds all rows.
    """
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    run = prefix_sums(counts, "x", ["c"])
    total = counts.agg(F.sum("c").cast("double").alias("n"))
    at = run.join(F.broadcast(total)).withColumn("f", dist.column("cdf", F.col("x")))
    gap = F.greatest(F.abs(F.col("upto_c") / F.col("n") - F.col("f")), F.abs((F.col("upto_c") - F.col("c")) / F.col("n") - F.col("f")))
    done = at.groupBy("n").agg(F.max(gap).alias("d"))
    return done.select(F.col("n").cast("long").alias("n"), "d", _ks_p(F.col("n"), F.col("d")).alias("p_value"))


def ks_two_sample(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """``n1, n2, d, p_value`` of the two-sided test of two groups."""
    from statloom.operators.stats import ks_two_sample as distance

    d = distance(df, value, group, first, second, digits=12)
    n = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    return d.select("n1", "n2", "d", _ks_p(n.cast("double"), F.col("d")).alias("p_value"))


def weighted_ranks(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``df`` with ``rank``: the mean rank of equal values within each group."""
    over = W.partitionBy(*by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(over.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.select(*by, value, (upto - (F.col("__c") - 1) / 2).alias("rank"))
    return df.join(ranks, [*by, value])
