"""Synthetic tables, made where they are needed from row numbers and a seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column | int) -> Column:
    """A number of [0, 1) from a seed and the parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *[p if isinstance(p, Column) else F.lit(p) for p in parts]), F.lit(1 << 53)) / float(1 << 53)


def normal(seed: int, *parts: Column | int) -> Column:
    """A standard normal number from a seed and the parts alone."""
    u, v = 1 - uniform(seed, *parts, 1), uniform(seed, *parts, 2)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def grid(spark: SparkSession, cells: Sequence[int], per_cell: int, noise: float = 0.15, seed: int = 0) -> DataFrame:
    """``id, features, label``: rows around the points of a grid, ``label`` the cell."""
    total = math.prod(cells)
    df = spark.range(total * per_cell).withColumn("label", (F.col("id") % total).cast("double"))
    xs, step = [], 1
    for i, n in enumerate(cells):
        xs.append(F.floor(F.col("label") / step) % n + noise * (2 * uniform(seed, F.col("id"), i) - 1))
        step *= n
    return df.select("id", F.array(*[x.cast("double") for x in xs]).alias("features"), "label")


def gaussian_classes(spark: SparkSession, n: int, means: Sequence[Sequence[float]], sd: float = 1.0, seed: int = 0) -> DataFrame:
    """``id, features, label``: ``n`` rows a class around each mean."""
    k, d = len(means), len(means[0])
    table = F.array(*[F.array(*[F.lit(float(v)) for v in m]) for m in means])
    df = spark.range(n * k).withColumn("label", F.col("id") % k)
    xs = F.array(*[F.get(F.get(table, F.col("label").cast("int")), F.lit(i)) + sd * normal(seed, F.col("id"), i) for i in range(d)])
    return df.select("id", xs.alias("features"), F.col("label").cast("double").alias("label"))


def circles(spark: SparkSession, n: int, radii: Sequence[float], noise: float = 0.1, seed: int = 0) -> DataFrame:
    """``id, features, label``: ``n`` rows on each of some circles."""
    k = len(radii)
    df = spark.range(n * k).withColumn("label", F.col("id") % k)
    r = F.get(F.array(*[F.lit(float(x)) for x in radii]), F.col("label").cast("int")) + noise * (2 * uniform(seed, F.col("id"), 7) - 1)
    a = 2 * math.pi * uniform(seed, F.col("id"), 8)
    return df.select("id", F.array(r * F.cos(a), r * F.sin(a)).alias("features"), F.col("label").cast("double").alias("label"))


def linear(spark: SparkSession, n: int, coefficients: Sequence[float], noise: float = 0.0, seed: int = 0) -> DataFrame:
    """``id, features, label``: uniform features and their weighted sum."""
    xs = [uniform(seed, F.col("id"), i) for i in range(len(coefficients))]
    y = F.lit(0.0)
    for x, c in zip(xs, coefficients):
        y = y + float(c) * x
    return spark.range(n).select("id", F.array(*xs).alias("features"), (y + noise * normal(seed, F.col("id"), 99)).alias("label"))
