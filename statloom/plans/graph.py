"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.plans.lineage import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of an undirected edge table.

    ``component`` is the smallest node reachable. Self loops and repeated edges
    are fine; rows with a null end are ignored; an empty table gives no rows.
    Each round is two aggregations and two joins on the remaining edges, their
    number falls geometrically in practice, and nothing is gathered on the
    driver but a count and a checksum.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = cut(ends.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = _mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    tree = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return tree.unionByName(roots).unionByName(loops).groupBy("node").agg(F.min("component").alias("component"))
