"""Dataset operators: missing values, priors, exact splits and folds.

Random order is a hash of a key and a seed, so a split is the same whatever the
partitions are, and may be made again by any engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a bucket of a seeded order, about.
BUCKET = 50_000


def shuffle_key(key: str, seed: int) -> Column:
    """A seeded pseudo-random order: md5 of seed/key, in hexadecimal."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null or NaN in ``columns``."""
    kinds = dict(df.dtypes)
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
        if kinds[c] in ("double", "float"):
            test = test & ~F.isnan(c)
    return df.where(test)


def count_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, missing`` for each column, in one pass."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | F.isnan(c) if kinds[c] in ("double", "float") else F.col(c).isNull()
    one = df.agg(*[F.sum(gone(c).cast("long")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])).alias("x")).select("x.*")


def priors(df: DataFrame, label: str, weight: str | None = None, digits: int = 9) -> DataFrame:
    """``label, n, prior``: weighted class frequencies."""
    w = F.col(weight) if weight else F.lit(1)
    sums = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(w).alias("w"))
    total = df.agg(F.sum(w).alias("__total"))  # one row
    return sums.join(F.broadcast(total)).select(label, "n", F.round(F.col("w") / F.col("__total"), digits).alias("prior"))


def ordered_position(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """``df`` with ``__at``: 0-based place in the seeded order, within ``by``.

    The order's hash is cut into buckets by its first digits, more for more
    ``rows`` (counted if not given); one row a bucket carries how many rows
    stand before it, so no window holds more than a bucket of a group.
    """
    n = df.count() if rows is None else rows
    digits = max(1, math.ceil(math.log(max(n / BUCKET, 1), 16)))
    keyed = df.withColumn("__key", shuffle_key(key, seed)).withColumn("__bucket", F.substring("__key", 1, digits))
    sums = keyed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    over = W.partitionBy(*by, F.lit(1)).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*by, "__bucket", F.coalesce(F.sum("__n").over(over), F.lit(0)).alias("__before"))
    inner = W.partitionBy(*by, "__bucket").orderBy("__key", key)
    joined = keyed.join(before, [*by, "__bucket"])
    return joined.select(*df.columns, (F.col("__before") + F.row_number().over(inner) - 1).alias("__at"))


def exact_split(df: DataFrame, key: str, shares: Sequence[float], seed: int = 1) -> DataFrame:
    """``df`` with ``split``: parts of exactly rounded sizes in seeded order; the rest is -1."""
    n = df.count()
    bounds, upto = [], 0.0
    for share in shares:
        upto += share
        bounds.append(round(upto * n))
    part = F.lit(-1)
    for i in reversed(range(len(bounds))):
        part = F.when(F.col("__at") < bounds[i], F.lit(i)).otherwise(part)
    return ordered_position(df, key, seed, rows=n).select(*df.columns, part.alias("split"))


def folds(df: DataFrame, key: str, k: int, seed: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``fold``: dealt round robin in seeded order, within classes ``by`` if given."""
    return ordered_position(df, key, seed, by).select(*df.columns, (F.col("__at") % k).cast("int").alias("fold"))


def all_but(folded: DataFrame, fold: int) -> DataFrame:
    """The union of all folds but one."""
    return folded.where(F.col("fold") != fold)


def sample(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) in seeded order, without replacement."""
    return ordered_position(df, key, seed).where(F.col("__at") < n).select(df.columns)


def bootstrap(df: DataFrame, key: str, rounds: int, seed: int = 1) -> DataFrame:
    """``df`` with ``round`` and ``times``: how often each of some bootstrap samples holds a row, a Poisson number of its key; rows held never go."""
    u = F.pmod(F.xxhash64(key, F.lit(seed), F.col("round")), F.lit(1 << 40)) / float(1 << 40)
    times, p, total = F.lit(0), math.exp(-1), 0.0
    for k in range(12):
        total += p
        times = F.when(u >= total, k + 1).otherwise(times)
        p /= k + 1
    return df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("times", times).where("times > 0")


def sparsity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``n, nonzero, share``: rows, and values that are known and not zero, in one pass."""
    used = F.lit(0)
    for c in columns:
        used = used + F.when(F.col(c).isNotNull() & (F.col(c) != 0), 1).otherwise(0)
    agg = df.agg(F.count("*").alias("n"), F.sum(used).cast("long").alias("nonzero"))
    return agg.select("n", "nonzero", (F.col("nonzero") / (F.col("n") * len(columns))).alias("share"))


def top_k(df: DataFrame, by: Sequence[str], order: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of least ``order`` (ties: of least ``key``) of every group, with ``rank``; each task keeps its own best first."""
    over = W.partitionBy(*by).orderBy(order, key)
    return df.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
