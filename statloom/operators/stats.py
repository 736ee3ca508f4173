"""Mergeable statistics: weighted moments, covariance, regression and tests.

Everything is power sums or built-in aggregates, so Spark aggregates partially
before it shuffles, and only one row a group moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moment_aggregates(x: Column, w: Column | None = None, prefix: str = "") -> list[Column]:
    """Aggregates ``n, s1..s4, min, max`` (weighted power sums); NaN and null are skipped."""
    ok = x.isNotNull() & ~F.isnan(x)
    v, weight = F.when(ok, x), F.when(ok, F.lit(1.0) if w is None else w)
    sums = [F.sum(weight).alias(f"{prefix}n")]
    sums += [F.sum(weight * F.pow(v, F.lit(k))).alias(f"{prefix}s{k}") for k in range(1, 5)]
    return [*sums, F.min(v).alias(f"{prefix}min"), F.max(v).alias(f"{prefix}max")]


def moments(df: DataFrame, x: str, by: Sequence[str] = (), weight: str | None = None, digits: int = 6) -> DataFrame:
    """``*by, n, mean, variance, skewness, kurtosis, min, max`` of one column.

    Variance is that of the population, kurtosis is the excess. Without a
    weight these are built-in aggregates, which merge central moments. With one
    they are power sums around the mean of all rows, so that a mean far from
    zero costs no digits.
    """
    r = lambda c: F.round(c, digits)
    value = F.col(x).cast("double")
    if weight is None:
        v = F.when(~F.isnan(value), value)
        agg = df.groupBy(*by).agg(F.count(v).cast("double").alias("n"), r(F.avg(v)).alias("mean"), r(F.var_pop(v)).alias("variance"), r(F.skewness(v)).alias("skewness"), r(F.kurtosis(v)).alias("kurtosis"), F.min(v).alias("min"), F.max(v).alias("max"))
        return agg
    center = df.select(F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(0.0)).alias("__c"))  # one row
    sums = df.join(F.broadcast(center)).groupBy(*by).agg(F.first("__c").alias("c"), *moment_aggregates(value - F.col("__c"), F.col(weight).cast("double")))
    n, m = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") / n - m * m
    m3 = F.col("s3") / n - 3 * m * F.col("s2") / n + 2 * m * m * m
    m4 = F.col("s4") / n - 4 * m * F.col("s3") / n + 6 * m * m * F.col("s2") / n - 3 * m * m * m * m
    return sums.select(
        *by, n.alias("n"), r(m + F.col("c")).alias("mean"), r(m2).alias("variance"),
        r(m3 / F.pow(m2, F.lit(1.5))).alias("skewness"), r(m4 / (m2 * m2) - 3).alias("kurtosis"),
        (F.col("min") + F.col("c")).alias("min"), (F.col("max") + F.col("c")).alias("max"),
    )


def covariance_matrix(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """``a, b, covariance, correlation`` for every pair of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.struct(F.covar_samp(a, b).alias("c"), F.corr(a, b).alias("r")).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}")["c"].alias("c"), F.col(f"{a}|{b}")["r"].alias("r")) for a, b in pairs])
    return row.select(F.explode(cells).alias("x")).select("x.a", "x.b", F.round("x.c", digits).alias("covariance"), F.round("x.r", digits).alias("correlation"))


def simple_regression(df: DataFrame, y: str, x: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """``*by, slope, intercept, r2`` of ``y`` on ``x``."""
    return df.groupBy(*by).agg(
        F.round(F.regr_slope(y, x), digits).alias("slope"),
        F.round(F.regr_intercept(y, x), digits).alias("intercept"),
        F.round(F.regr_r2(y, x), digits).alias("r2"),
    )


def ks_two_sample(df: DataFrame, value: str, group: str, first: str, second: str, digits: int = 9) -> DataFrame:
    """``n1, n2, d``: the two-sided Kolmogorov-Smirnov distance of two groups.

    Values are counted first, so one row a distinct value is ordered; the
    running counts use a range-partitioned prefix sum.
    """
    some = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    counts = some.groupBy(value).agg(F.sum((F.col(group) == first).cast("long")).alias("a"), F.sum((F.col(group) == second).cast("long")).alias("b"))
    run = prefix_sums(counts, value, ["a", "b"])
    total = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    gap = F.abs(F.col("upto_a") / F.col("n1") - F.col("upto_b") / F.col("n2"))
    return run.join(F.broadcast(total)).groupBy("n1", "n2").agg(F.round(F.max(gap), digits).alias("d"))


def prefix_sums(df: DataFrame, order: str, columns: Sequence[str], rows: int = 50_000) -> DataFrame:
    """``df`` with ``upto_<c>``: sums over all rows not above this row's ``order``.

    Rows are dealt to blocks of about ``rows`` by quantiles of ``order`` (at
    most 4,096 bounds come to the driver); one row a block is summed over all
    blocks.
    """
    blocks = max(4, min(4096, -(-df.count() // rows)))
    bounds = sorted({b for b in (df.agg(F.percentile_approx(order, [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] or [])})
    block = F.lit(0)
    if bounds:
        table = F.array(*[F.lit(b) for b in bounds])
        size = 1 << len(bounds).bit_length()
        halves = F.array(*[F.lit(size >> i) for i in range(1, size.bit_length())])
        block = F.aggregate(halves, F.lit(0), lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) < F.col(order)), at + s).otherwise(at))
    dealt = df.withColumn("__block", block)
    sums = dealt.groupBy("__block").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    over = W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("__block", *[F.coalesce(F.sum(f"__{c}").over(over), F.lit(0)).alias(f"__{c}") for c in columns])
    inner = W.partitionBy("__block").orderBy(order)
    out = dealt.join(F.broadcast(before), "__block")
    return out.select(*df.columns, *[(F.col(f"__{c}") + F.sum(c).over(inner)).alias(f"upto_{c}") for c in columns])


def one_sample_tests(df: DataFrame, value: str, by: Sequence[str], mean: float, sd: float, digits: int = 6) -> DataFrame:
    """``*by, n, t, z``: T statistic (population deviation) and Z statistic (given deviation)."""
    x = F.col(value)
    agg = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"))
    root = F.sqrt(F.col("n").cast("double"))
    return agg.select(*by, "n", F.round((F.col("m") - mean) * root / F.col("s"), digits).alias("t"), F.round((F.col("m") - mean) * root / sd, digits).alias("z"))


def weighted_median(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """``*by, median``: least value whose running weight reaches half of the group's.

    Weights of equal values are added first, so a group's window holds its
    distinct values only.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("w"))
    group = W.partitionBy(*by)
    upto = F.sum("w").over(group.orderBy(value))
    return sums.withColumn("upto", upto).withColumn("total", F.sum("w").over(group)).where("2 * upto >= total").groupBy(*by).agg(F.min(value).alias("median"))


# A mergeable state of moments: n, mean, and sums of powers of deviations from it.
def moment_state(x: Column) -> Column:
    """An aggregate: the state of a column's known values as a struct."""
    v = F.when(~F.isnan(x.cast("double")), x.cast("double"))
    n, var = F.count(v).cast("double"), F.coalesce(F.var_pop(v), F.lit(0.0))
    skew, kurt = F.coalesce(F.skewness(v), F.lit(0.0)), F.coalesce(F.kurtosis(v), F.lit(-3.0))
    third = F.when(F.isnan(skew), 0.0).otherwise(skew) * F.pow(var, F.lit(1.5)) * n
    fourth = (F.when(F.isnan(kurt), -3.0).otherwise(kurt) + 3) * var * var * n
    return F.struct(n.alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), (var * n).alias("m2"), third.alias("m3"), fourth.alias("m4"))


def merge_moments(a: Column, b: Column) -> Column:
    """The state of both tables' values."""
    return _combined(a, b)


def remove_moments(whole: Column, part: Column) -> Column:
    """The state of the values of ``whole`` without those of ``part``."""
    n = whole["n"] - part["n"]
    mean = F.when(n > 0, (whole["n"] * whole["mean"] - part["n"] * part["mean"]) / n).otherwise(0.0)
    d, p = part["mean"] - mean, part["n"]
    t = whole["n"]
    m2 = whole["m2"] - part["m2"] - d * d * n * p / t
    m3 = whole["m3"] - part["m3"] - d * d * d * n * p * (n - p) / (t * t) - 3 * d * (n * part["m2"] - p * m2) / t
    m4 = whole["m4"] - part["m4"] - F.pow(d, F.lit(4.0)) * n * p * (n * n - n * p + p * p) / (t * t * t) - 6 * d * d * (n * n * part["m2"] + p * p * m2) / (t * t) - 4 * d * (n * part["m3"] - p * m3) / t
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))


def _combined(a: Column, b: Column) -> Column:
    n, p = a["n"], b["n"]
    t, d = n + p, b["mean"] - a["mean"]
    safe = F.greatest(t, F.lit(1.0))
    m2 = a["m2"] + b["m2"] + d * d * n * p / safe
    m3 = a["m3"] + b["m3"] + d * d * d * n * p * (n - p) / (safe * safe) + 3 * d * (n * b["m2"] - p * a["m2"]) / safe
    m4 = a["m4"] + b["m4"] + F.pow(d, F.lit(4.0)) * n * p * (n * n - n * p + p * p) / (safe * safe * safe) + 6 * d * d * (n * n * b["m2"] + p * p * a["m2"]) / (safe * safe) + 4 * d * (n * b["m3"] - p * a["m3"]) / safe
    return F.struct(t.alias("n"), (a["mean"] + d * p / safe).alias("mean"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))


def from_moments(s: Column) -> list[Column]:
    """``n, mean, variance, skewness, kurtosis`` of a state."""
    var = s["m2"] / s["n"]
    return [s["n"].alias("n"), s["mean"].alias("mean"), var.alias("variance"), (s["m3"] / s["n"] / F.pow(var, F.lit(1.5))).alias("skewness"), (s["m4"] / s["n"] / (var * var) - 3).alias("kurtosis")]


def margins(df: DataFrame, by: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of every combination of values of ``by`` and of all its margins (null: any), with ``level``, a bit for each column left out."""
    return df.cube(*by).agg(F.grouping_id().alias("level"), *aggregates)
