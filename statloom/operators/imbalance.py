"""Synthetic rows for a rare class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.neighbors import nearest
from statloom.plans.lineage import cut
from statloom.sources.generated import uniform


def _between(few: DataFrame, near: DataFrame, per_row: int, seed: int, reach: float = 1.0) -> DataFrame:
    """``features``: for each (q, copy) a seeded neighbour and a seeded point on the way to it."""
    copies = few.select(F.col("id").alias("q"), F.col("features").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(per_row))).alias("copy"))
    count = near.groupBy("q").agg(F.count("*").alias("k"))
    drawn = copies.join(count, "q").withColumn("rank", (1 + F.floor(uniform(seed, F.col("q"), F.col("copy"), 1) * F.col("k"))).cast("int"))
    pairs = drawn.join(near.select("q", "rank", "v"), ["q", "rank"]).join(few.select(F.col("id").alias("v"), F.col("features").alias("b")), "v")
    gap = reach * uniform(seed, F.col("q"), F.col("copy"), 2)
    return pairs.select("q", "copy", F.zip_with("a", "b", lambda x, y: x + gap * (y - x)).alias("features"))


def smote(df: DataFrame, label: float, per_row: int = 1, k: int = 5, seed: int = 0) -> DataFrame:
    """``q, copy, features, label``: ``per_row`` rows of a class for each of its rows, on the way to one of its ``k`` nearest of that class.

    A class of one row makes none.
    """
    few = cut(df.where(F.col("label") == label).select("id", "features"))
    near = nearest(few, few, k + 1).where("q <> v")
    ranked = cut(near.withColumn("rank", F.row_number().over(_window())).where(F.col("rank") <= k))
    return _between(few, ranked, per_row, seed).withColumn("label", F.lit(float(label)))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("q").orderBy("distance", "v")


def borderline_smote(df: DataFrame, label: float, per_row: int = 1, k: int = 5, around: int = 10, seed: int = 0, towards_all: bool = False) -> DataFrame:
    """Like ``smote`` for rows in danger only: half or more, but not all, of their ``around`` nearest rows are of other classes.

    ``towards_all`` also makes rows up to half way to neighbours of other classes.
    """
    rows = cut(df.select("id", "features", "label"))
    few = cut(rows.where(F.col("label") == label).select("id", "features"))
    near = nearest(few, rows, around + 1).where("q <> v")
    around_rows = near.withColumn("rank", F.row_number().over(_window())).where(F.col("rank") <= around)
    seen = around_rows.join(rows.select(F.col("id").alias("v"), (F.col("label") != label).cast("int").alias("other")), "v")
    danger = cut(seen.groupBy("q").agg(F.sum("other").alias("m"), F.count("*").alias("n")).where("2 * m >= n and m < n").select(F.col("q").alias("id")))
    some = few.join(danger, "id", "left_semi")
    own = nearest(some, few, k + 1).where("q <> v")
    ranked = cut(own.withColumn("rank", F.row_number().over(_window())).where(F.col("rank") <= k))
    out = _between(few, ranked, per_row, seed)
    if towards_all:
        others = seen.where("other = 1").select("q", "v", "distance").join(danger.select(F.col("id").alias("q")), "q", "left_semi")
        far = cut(others.withColumn("rank", F.row_number().over(_window())).where(F.col("rank") <= k))
        out = out.unionByName(_between(rows.select("id", "features"), far, per_row, seed + 1, 0.5))
    return out.withColumn("label", F.lit(float(label)))
