"""Nearest neighbours by an index of random projections.

Every composite of the index projects the vectors on a few random directions
and keeps them range-partitioned and sorted by the first projection, in
buckets of like size. Two vectors at distance ``d`` in ``D`` dimensions differ by
about ``d / sqrt(D)`` in each projection, whatever the other vectors are. A query
reads the buckets around its own value, which gives it an upper bound of its
``k``-th distance, and then widens its interval to what that bound asks for;
vectors that enough projections of a composite place inside the interval are
candidates and get their exact distance.

No bucket is capped: one of any size, such as that of many equal values, is
stored in blocks, and only the best few of a block are passed on for a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.operators.neighbors import _paired
from statloom.plans.lineage import cut

#: Vectors of a bucket on average, and of a block at most on average; the most bounds of a composite that tasks know.
BUCKET, BLOCK, BOUNDS = 512, 2048, 4096

#: Tasks, at most, that blocks are dealt to; queries that meet a block at once.
TASKS, STEP = 8192, 256


def _nearest_named(q_ids: np.ndarray, x: np.ndarray, at: np.ndarray, reach: np.ndarray, ids: np.ndarray, held: np.ndarray, inside: np.ndarray, needed: int, k: int, others: bool) -> pd.DataFrame:
    """``q, v, distance`` of the ``k`` nearest of each query among the rows that ``needed`` projections place within its reach.

    Products of matrices tell which rows may be among them, with room for what they round; those get their exact distance.
    """
    within = np.zeros((len(x), len(ids)), dtype=np.uint8)
    for j in range(at.shape[1]):
        within += np.abs(inside[None, :, j] - at[:, j : j + 1]) <= reach[:, None]
    named = within >= needed
    if others:
        named &= ids[None, :] != q_ids[:, None]
    with np.errstate(invalid="ignore", over="ignore"):
        xx, vv = (x * x).sum(axis=1), (held * held).sum(axis=1)
        d = xx[:, None] + vv[None, :] - 2 * x @ held.T
        d = np.where(named, np.where(np.isfinite(d), d, np.finfo(float).max), np.inf)
        m = min(k, len(ids))
        room = 1e-12 * (np.where(np.isfinite(xx), xx, 0) + vv.max(initial=0, where=np.isfinite(vv)))
        r, c = np.nonzero(named & (d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m] + room[:, None]))
        exact = _paired(x[r], held[c], "euclidean")
    order = np.lexsort((ids[c], exact, r))
    r, c, exact = r[order], c[order], exact[order]
    best = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pd.DataFrame({"q": q_ids[r[best]], "v": ids[c[best]], "distance": exact[best]})


class ProjectionIndex:
    """An index over ``vectors(id, vec)`` of equal lengths: ``composites`` of ``simple`` projections each.

    ``width`` is how many standard deviations of a neighbour's projection an
    interval reaches; of the ``simple`` projections ``needed`` (by default seven
    of eight) must place a candidate inside. Larger widths and more composites
    find more and cost more. Rows without an id or vector are left out; of rows
    that repeat an id the nearest counts.
    """

    def __init__(self, vectors: DataFrame, composites: int = 2, simple: int = 8, width: float = 2.0, needed: int | None = None, seed: int = 0) -> None:
        rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
        size, self.n = rows.agg(F.max(F.size("vec")), F.count("*")).first()
        self.dims, self.width, self.needed = size or 1, width, needed or max(1, simple - simple // 8)
        directions = np.random.default_rng(seed).normal(size=(composites, simple, self.dims))
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.table, self.bounds = None, []
        valued = cut(self._valued(rows))
        buckets = min(BOUNDS, -(-self.n // BUCKET))
        for c in range(composites):
            marks = [i / buckets for i in range(1, buckets)]
            got = valued.where(F.col("composite") == c).agg(F.percentile_approx("value", marks, 10 * buckets)).first()[0] if marks else []
            self.bounds.append(np.unique(got or []))
        self.add(vectors=None, valued=valued)

    def _valued(self, rows: DataFrame) -> DataFrame:
        """``composite, value, id, vec``: each vector's first projection of every composite."""
        first = self.directions[:, 0, :]

        @F.pandas_udf("array<double>")
        def values(vec: pd.Series) -> pd.Series:
            return pd.Series(list(np.stack(vec.to_numpy()).astype(float) @ first.T), dtype=object) if len(vec) else pd.Series([], dtype=object)

        return rows.select("id", "vec", F.posexplode(values("vec")).alias("composite", "value"))

    def add(self, vectors: DataFrame | None, valued: DataFrame | None = None) -> None:
        """Adds vectors; the bounds of buckets stay, whose blocks grow in number."""
        if valued is None:
            rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
            valued = self._valued(rows)
            self.n += rows.count()
        bounds = self.bounds

        @F.pandas_udf("int")
        def bucket(composite: pd.Series, value: pd.Series) -> pd.Series:
            out = np.zeros(len(value), dtype=np.int32)
            for c, marks in enumerate(bounds):
                mine = (composite == c).to_numpy()
                out[mine] = np.searchsorted(marks, value.to_numpy()[mine])
            return pd.Series(out)

        placed = valued.withColumn("bucket", bucket("composite", "value"))
        stored = cut(placed.repartitionByRange("composite", "value").sortWithinPartitions("composite", "value"))
        self.table = stored if self.table is None else self.table.unionByName(stored)
        self.blocks = cut(self.table.groupBy("composite", "bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        self.parts = int(self.blocks.agg(F.sum("blocks")).first()[0] or 0)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """``id, vec, reach, composite, bucket``: every bucket that a query's interval of half-width ``reach`` meets."""
        first, bounds = self.directions[:, 0, :], self.bounds

        @F.pandas_udf("array<struct<composite:int,low:int,high:int>>")
        def met(vec: pd.Series, reach: pd.Series) -> pd.Series:
            if not len(vec):
                return pd.Series([], dtype=object)
            at, r = np.stack(vec.to_numpy()).astype(float) @ first.T, reach.to_numpy()[:, None]
            low = np.stack([np.searchsorted(marks, at[:, c] - r[:, 0]) for c, marks in enumerate(bounds)], axis=1)
            high = np.stack([np.searchsorted(marks, at[:, c] + r[:, 0]) for c, marks in enumerate(bounds)], axis=1)
            return pd.Series([[{"composite": c, "low": int(x), "high": int(y)} for c, (x, y) in enumerate(zip(a, b))] for a, b in zip(low, high)], dtype=object)

        x = queries.select("id", "vec", "reach", F.explode(met("vec", "reach")).alias("m"))
        return x.select("id", "vec", "reach", "m.composite", F.explode(F.sequence("m.low", "m.high")).alias("bucket"))

    def _found(self, asked: DataFrame, k: int, others: bool) -> DataFrame:
        """``q, v, distance``: of every block the ``k`` best that a query's projections name."""
        stored = self.table.join(self.blocks, ["composite", "bucket"])
        stored = stored.select("composite", "bucket", F.pmod(F.xxhash64("id", "vec"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "vec", F.lit(0.0).alias("reach"))
        asks = asked.join(self.blocks, ["composite", "bucket"])
        asks = asks.select("composite", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "vec", "reach")
        # a task for about each block: left to their bytes, which are few, blocks would share tasks whose time grows with the square of the rows
        rows = stored.unionByName(asks).repartition(max(1, min(TASKS, self.parts)), "composite", "bucket", "block").sortWithinPartitions("composite", "bucket", "block", "side")
        directions, needed = self.directions, self.needed

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            here, ids, held, inside = None, [], [], None
            for batch in batches:
                for (c, b, block, side), some in batch.groupby(["composite", "bucket", "block", "side"], sort=True):
                    if (c, b, block) != here:
                        here, ids, held, inside = (c, b, block), [], [], None
                    x = np.stack(some["vec"]).astype(float)
                    if side == 0:
                        ids.append(some["id"].to_numpy())
                        held.append(x)
                        continue
                    if not ids:
                        continue
                    if inside is None:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                        inside = held[0] @ directions[c].T
                    q_ids, reach, mine = some["id"].to_numpy(), some["reach"].to_numpy(), x @ directions[c].T
                    for i in range(0, len(x), STEP):
                        part = slice(i, i + STEP)
                        yield _nearest_named(q_ids[part], x[part], mine[part], reach[part], ids[0], held[0], inside, needed, k, others)

        return rows.mapInPandas(task, "q long, v long, distance double")

    def nearest(self, queries: DataFrame, k: int, others: bool = True) -> DataFrame:
        """``q, rank, v, distance``: each query's ``k`` nearest found, ties to the smaller id.

        Distances are exact; with ``others`` a vector of the query's own id is
        left out. Most of the true neighbours are found; which are not depends on
        the seed only. A query whose first buckets hold fewer than ``k`` others
        reads everything. A repeated query id is asked once, with its least vector.
        """
        asks = queries.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id is not null and size(vec) > 0")
        asks = cut(asks.groupBy("id").agg(F.min("vec").alias("vec")))
        order = W.partitionBy("q").orderBy("distance", "v")

        def best(found: DataFrame) -> DataFrame:
            one = found.groupBy("q", "v").agg(F.min("distance").alias("distance"))  # a vector that several composites name
            return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "v", "distance")

        wide = float("inf")
        near = self._asked(asks.select("id", "vec", F.lit(0.0).alias("reach"))).withColumn("reach", F.lit(wide))  # all of the query's own buckets
        bound = cut(best(self._found(near, k, others))).groupBy("q").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        reach = F.when(F.col("n") >= k, self.width * F.col("far") / math.sqrt(self.dims) + 1e-12).otherwise(wide)
        widened = asks.join(bound, asks["id"] == bound["q"], "left").select("id", "vec", reach.alias("reach"))
        return best(self._found(self._asked(widened), k, others))
