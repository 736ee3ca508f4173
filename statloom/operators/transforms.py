"""Feature transforms and selection: one aggregation, then a projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _fitted(df: DataFrame, columns: Sequence[str], aggs: dict[str, Callable[[str], Column]], apply: Callable, digits: int | None = 6) -> DataFrame:
    """``df`` with ``apply(column, its aggregates)``; the aggregates are one row, broadcast."""
    row = df.agg(*[f(c).alias(f"__{k}_{c}") for c in columns for k, f in aggs.items()])
    made = {c: apply(F.col(c), {k: F.col(f"__{k}_{c}") for k in aggs}) for c in columns}
    out = df.join(F.broadcast(row))
    return out.select(*[(F.round(made[c], digits) if digits is not None else made[c]).alias(c) if c in made else F.col(c) for c in df.columns])


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fitted(df, columns, {"m": F.avg, "v": F.var_pop}, lambda x, a: (x - a["m"]) / F.sqrt(a["v"] + 1e-10))


def zero_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fitted(df, columns, {"m": F.avg}, lambda x, a: x - a["m"])


def unit_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fitted(df, columns, {"v": F.var_pop}, lambda x, a: x / F.sqrt(a["v"]))


def linear_scale(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return _fitted(df, columns, {"lo": F.min, "hi": F.max}, lambda x, a: (x - a["lo"]) / (a["hi"] - a["lo"]) * (high - low) + low)


def histogram_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Bin numbers of equal width from the least to the largest value."""
    at = lambda x, a: F.least(F.lit(bins - 1), F.floor((x - a["lo"]) / ((a["hi"] - a["lo"]) / bins))).cast("int")
    return _fitted(df, [column], {"lo": F.min, "hi": F.max}, at, digits=None)


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column a value; a missing or unknown value is all zero."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def impute(df: DataFrame, mean: Sequence[str] = (), mode: Sequence[str] = ()) -> DataFrame:
    """Fills nulls by the column's mean or most frequent value (ties: the least)."""
    aggs = [F.avg(c).alias(f"__m_{c}") for c in mean]
    out = df.join(F.broadcast(df.agg(*aggs))) if aggs else df
    for c in mode:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
        out = out.join(F.broadcast(counts.agg(F.max_by(c, F.struct("n")).alias("x"), F.min(F.struct(-F.col("n"), F.col(c).alias("v"))).alias("best")).select(F.col("best.v").alias(f"__f_{c}"))))
    fill = {c: F.coalesce(c, f"__m_{c}") for c in mean} | {c: F.coalesce(c, f"__f_{c}") for c in mode}
    return out.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in df.columns])


def polynomial(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with all products of two of the columns."""
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]])


def mutual_information(df: DataFrame, label: str, features: Sequence[str], digits: int = 9) -> DataFrame:
    """``feature, mutual_information`` in nats, from each feature's contingency table."""
    out = None
    for f in features:
        cell = df.groupBy(F.col(label).alias("a"), F.col(f).alias("b")).agg(F.count("*").cast("double").alias("n"))
        n, t = F.col("n"), F.col("t")
        cell = cell.join(F.broadcast(cell.agg(F.sum("n").alias("t"))))  # one row
        x, y = F.sum("n").over(W.partitionBy("a")), F.sum("n").over(W.partitionBy("b"))
        one = cell.select((n / t * F.log(n * t / (x * y))).alias("i")).agg(F.lit(f).alias("feature"), F.round(F.sum("i"), digits).alias("mutual_information"))
        out = one if out is None else out.unionByName(one)
    return out


def gini_gains(df: DataFrame, column: str, label: str, classes: Sequence[str], digits: int = 9) -> DataFrame:
    """``threshold, gain`` of every split ``column <= threshold``, by running class counts."""
    from statloom.operators.stats import prefix_sums

    names = [f"k{i}" for i in range(len(classes))]
    counts = df.groupBy(F.col(column).alias("threshold")).agg(*[F.sum((F.col(label) == c).cast("double")).alias(k) for k, c in zip(names, classes)])
    run = prefix_sums(counts, "threshold", names).join(F.broadcast(counts.agg(*[F.sum(k).alias(f"t_{k}") for k in names])))
    low, all_ = [F.col(f"upto_{k}") for k in names], [F.col(f"t_{k}") for k in names]
    add = lambda xs: sum(xs[1:], xs[0])
    n, t = add(low), add(all_)
    gini = lambda xs, m: 1 - add([x * x for x in xs]) / (m * m)
    gain = gini(all_, t) - n / t * gini(low, n) - (t - n) / t * gini([b - a for a, b in zip(low, all_)], t - n)
    return run.where(n < t).select("threshold", F.round(gain, digits).alias("gain"))
