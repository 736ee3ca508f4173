"""Embeddings that place every row, by distances to a bounded number of landmarks.

Landmarks are scaled classically on the driver, from their own distances alone; every
row is then placed by its distances to them (landmark scaling), as sums in
Spark. Where all rows are landmarks this is classical scaling itself. Isomap's
distances are path lengths in the graph of nearest neighbours, found in rounds of joins
in which only rows whose distance fell carry on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.neighbors import _distances, knn_join
from statloom.plans.graph import connected_components
from statloom.plans.lineage import cut, forget

#: Landmarks by default and at most.
LANDMARKS, MOST = 128, 1024


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, id, d``: the length of the shortest path from each of ``sources(source)`` to every row it reaches.

    ``edges(a, b, w)`` are undirected, with weights of nothing or more; a source reaches itself even without edges. A
    round extends the paths found last by one edge; there are as many rounds as the longest of the shortest paths
    has edges.
    """
    some = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("w").cast("double").alias("w")).where("a is not null and b is not null and w is not null")
    both = cut(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w")))
    known = cut(sources.select(F.col("source").cast("long").alias("source")).distinct().select("source", F.col("source").alias("id"), F.lit(0.0).alias("d"), F.lit(True).alias("fresh")))
    while not known.where("fresh").isEmpty():
        step = known.where("fresh").join(both, F.col("id") == F.col("a")).select("source", F.col("b").alias("id"), (F.col("d") + F.col("w")).alias("d"))
        old = known.select("source", "id", F.col("d").alias("old"), F.lit(None).cast("double").alias("new"))
        new = step.groupBy("source", "id").agg(F.min("d").alias("new")).select("source", "id", F.lit(None).cast("double").alias("old"), "new")
        best = old.unionByName(new).groupBy("source", "id").agg(F.min("old").alias("old"), F.min("new").alias("new"))
        before, known = known, cut(best.select("source", "id", F.least("old", "new").alias("d"), (F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old")))).alias("fresh")))
        forget(known.sparkSession, before)
    return known.select("source", "id", "d")


def _landmarks(rows: DataFrame, n: int, seed: int) -> tuple[list[int], np.ndarray]:
    got = rows.select("id", "vec", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h", "id").limit(min(n, MOST)).collect()
    return [r.id for r in got], np.array([r.vec for r in got], dtype=float)


def _placed(rows: DataFrame, away: DataFrame, ids: list[int], d: np.ndarray, k: int) -> DataFrame:
    """``id, x`` by landmark scaling: ``away(source, id, d)`` to all rows, ``d`` among the landmarks ``ids``."""
    squares = d * d
    centred = np.eye(len(ids)) - 1 / len(ids)
    values, vectors = np.linalg.eigh(-0.5 * centred @ squares @ centred)
    order = np.argsort(values)[::-1][:k]
    keep = np.maximum(values[order], 0)
    axes = np.where(keep > 1e-9 * max(keep.max(initial=0.0), 1e-300), vectors[:, order] / np.sqrt(np.maximum(keep, 1e-300)), 0.0)
    mean = squares.mean(axis=0)
    table = rows.sparkSession.createDataFrame([(i, float(m), [float(v) for v in a]) for i, m, a in zip(ids, mean, axes)], "source long, mean double, axis array<double>")
    x = away.join(F.broadcast(table), "source").withColumn("off", -0.5 * (F.col("d") * F.col("d") - F.col("mean")))  # a row a landmark
    sums = x.groupBy("id").agg(*[F.sum(F.col("off") * F.col("axis")[i]).alias(f"x{i}") for i in range(len(order))])
    zeros = [F.lit(0.0)] * (k - len(order))
    return rows.select("id").join(sums.select("id", F.array(*[F.col(f"x{i}") for i in range(len(order))], *zeros).alias("x")), "id")


def landmark_mds(rows: DataFrame, k: int = 2, landmarks: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """``id, x`` of every row of ``rows(id, vec)``: positions whose distances are near those of the vectors."""
    rows = cut(rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    ids, held = _landmarks(rows, landmarks, seed)
    if not ids:
        return rows.select("id", F.col("vec").alias("x"))

    @F.pandas_udf("array<double>")
    def to(vec: pd.Series) -> pd.Series:
        return pd.Series(list(_distances(np.stack(vec.to_numpy()).astype(float), held)), dtype=object) if len(vec) else pd.Series([], dtype=object)

    names = F.array(*[F.lit(i).cast("long") for i in ids])
    away = rows.select("id", F.posexplode(to("vec")).alias("n", "d")).select(F.element_at(names, F.col("n") + 1).alias("source"), "id", "d")
    return _placed(rows, away, ids, _distances(held, held), k)


def neighbour_graph(rows: DataFrame, neighbours: int, ids: list[int], held: np.ndarray) -> DataFrame:
    """``a, b, w``: nearest neighbours, made one part by a spanning tree of the landmarks and an edge from each part without one to its nearest."""
    near = knn_join(rows, rows, neighbours)
    edges = cut(near.select(F.least("q", "v").alias("a"), F.greatest("q", "v").alias("b"), F.col("distance").alias("w")).distinct())
    parts = cut(rows.select("id").join(connected_components(edges, "a", "b"), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("part")))
    spark = rows.sparkSession
    chosen = parts.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id long")), "id").collect()  # a row a landmark
    part = {r.id: r.part for r in chosen}
    d = _distances(held, held)
    inside, bridges = {part[ids[0]]}, []
    while len(inside) < len(set(part.values())):
        here = np.array([part[i] in inside for i in ids])
        gap = np.where(here[:, None] & ~here[None, :], d, np.inf)
        i, j = np.unravel_index(gap.argmin(), gap.shape)
        bridges.append((ids[i], ids[j], float(d[i, j])))
        inside.add(part[ids[j]])
    lone = parts.where(~F.col("part").isin(*set(part.values())) & (F.col("id") == F.col("part"))).select("id").join(rows, "id")

    @F.pandas_udf("b long, w double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        if not len(vec):
            return pd.DataFrame({"b": [], "w": []})
        away = _distances(np.stack(vec.to_numpy()).astype(float), held)
        at = away.argmin(axis=1)
        return pd.DataFrame({"b": np.array(ids)[at], "w": away[np.arange(len(at)), at]})

    lone = lone.select(F.col("id").alias("a"), nearest("vec").alias("p")).select("a", "p.b", "p.w")
    return cut(edges.unionByName(spark.createDataFrame(bridges, "a long, b long, w double")).unionByName(lone))


def isomap(rows: DataFrame, k: int = 2, neighbours: int = 10, landmarks: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """``id, x`` of every row of ``rows(id, vec)``: landmark scaling of path lengths in the graph of ``neighbours`` nearest rows.

    Parts of the graph that no edge joins are joined by the shortest gaps between landmarks, or
    between the least row of a part without one and its nearest landmark. An
    empty table has no rows.
    """
    rows = cut(rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    ids, held = _landmarks(rows, landmarks, seed)
    if not ids:
        return rows.select("id", F.col("vec").alias("x"))
    graph = neighbour_graph(rows, neighbours, ids, held)
    sources = rows.sparkSession.createDataFrame([(i,) for i in ids], "source long")
    away = cut(shortest_paths(graph, sources))
    place = {i: n for n, i in enumerate(ids)}
    d = np.zeros((len(ids), len(ids)))
    for r in away.join(F.broadcast(sources.withColumnRenamed("source", "id")), "id").collect():  # landmarks among themselves
        d[place[r.source], place[r.id]] = r.d
    return _placed(rows, away, ids, (d + d.T) / 2, k)
