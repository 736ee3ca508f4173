"""Exact and hashed similarity joins over vectors, and what rests on them.

Exact joins use a ball cover: a bounded sample of pivots deals the vectors to
cells with known radii, and the triangle inequality tells which cells a query
must visit. Near cells are asked together, by groups of bounded size. Data with clusters skip most cells; where nothing can be skipped
the work is the product of both sizes, in blocks. Cells of any size are stored
in blocks, each compared with the queries that came by matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.plans.lineage import cut

#: Rows of a block on average, the most pivots, and rows of cells that are asked together.
BLOCK, PIVOTS, GROUP = 2048, 256, 8192


#: Distances that loops over the dimensions keep at hand.
HELD = 1 << 17

#: Queries with a reach that meet a block at once, so that their distances stay in a core's cache.
NEAR = 64

#: Metrics that the triangle inequality holds for.
METRICS = ("euclidean", "manhattan", "chebyshev")


def _distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    if metric == "euclidean":
        d = 2 * a @ b.T
        np.subtract((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :], d, out=d)
        return np.sqrt(np.maximum(d, 0, out=d), out=d)
    out, d, columns = np.zeros((len(a), len(b))), np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    for j in range(a.shape[1]):
        np.abs(np.subtract(a[:, j : j + 1], columns[j], out=d), out=d)
        (np.add if metric == "manhattan" else np.maximum)(out, d, out=out)
    return out


def _paired(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to the rows beside them."""
    d = np.abs(a - b)
    return np.sqrt((d * d).sum(1)) if metric == "euclidean" else d.sum(1) if metric == "manhattan" else d.max(axis=1, initial=0)


def _within(q: np.ndarray, v: np.ndarray, squares: np.ndarray, r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of all pairs within the rows' reaches ``r``, and perhaps few beyond them; None if they are more than ``most``."""
    own, r = (q * q).sum(1), np.where(np.isfinite(r), r, np.inf)
    d = 2 * q @ v.T
    np.subtract(squares[None, :], d, out=d)
    room = 1e-9 * (1 + r) + 1e-12 * (own + np.fmax.reduce(squares))  # more than sums of products may be off
    at = np.flatnonzero(d <= (r * r + room - own)[:, None])
    return None if len(at) > most else np.divmod(at, len(v))


def _coded(q: np.ndarray, v: np.ndarray, r: np.ndarray | None, k: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of all pairs whose city-block distance is within the rows' reaches ``r``, or without them of each row's ``k`` nearest, and some beyond; None if they are more than ``most``.

    Vectors are rounded to steps whose sums fit 16 bits; a rounded distance is off by a step a dimension at most.
    """
    dims = v.shape[1]
    levels = 32_767 // max(dims, 1)
    low = np.minimum(q.min(axis=0), v.min(axis=0))
    step = float((np.maximum(q.max(axis=0), v.max(axis=0)) - low).max(initial=0)) / max(levels, 1)
    if levels < 16 or not np.isfinite(step) or step <= 0:
        return None
    a, columns = np.rint((q - low) / step).astype(np.int16), np.ascontiguousarray(np.rint((v - low) / step).astype(np.int16).T)
    found, some, total = [], max(1, HELD // len(v)), 0
    for i in range(0, len(q), some):
        one = a[i : i + some]
        out, d = np.zeros((len(one), len(v)), dtype=np.int16), np.empty((len(one), len(v)), dtype=np.int16)
        for j in range(dims):
            np.abs(np.subtract(one[:, j : j + 1], columns[j], out=d), out=d)
            np.add(out, d, out=out)
        if r is None:
            m = min(k, len(v))
            top = np.partition(out, m - 1, axis=1)[:, m - 1].astype(float) + 2 * dims + 2
        else:
            top = np.where(np.isfinite(r[i : i + some]), r[i : i + some], np.inf) / step * (1 + 1e-9) + dims + 2
        at = np.flatnonzero(out <= np.minimum(top, 32_767).astype(np.int16)[:, None])
        total += len(at)
        if total > most:
            return None
        found.append(at + i * len(v))
    return np.divmod(np.concatenate(found), len(v)) if found else None


def _compared(members: DataFrame, asks: DataFrame, keep: Callable[[np.ndarray], np.ndarray], metric: str = "euclidean", block: int = BLOCK, least: int = 0) -> DataFrame:
    """``q, v, distance`` of the pairs that ``keep(distances)`` selects, between rows of the same ``cell``.

    ``members(cell, id, vec)`` lie in blocks; ``asks(cell, id, vec)`` go to each
    block of their cell. Distances are exact. With ``least``, ``asks`` have a
    reach ``r``: what lies within it is taken as it is, unless that is much more
    than ``least`` a row, where ``keep`` chooses.
    """
    reach, few = ["r"] if least else [], getattr(keep, "k", 0)
    blocks = cut(members.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    stored = members.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "vec", *[F.lit(0.0).alias(c) for c in reach])
    asked = asks.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "vec", *reach)
    rows = stored.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "side", "id")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids, held = None, [], []
        for batch in batches:
            for (a, b, side), some in batch.groupby(["cell", "block", "side"], sort=True):
                if (a, b) != here:
                    here, ids, held = (a, b), [], []
                x = np.stack(some["vec"]).astype(float)
                if side == 0:
                    ids.append(some["id"].to_numpy())
                    held.append(x)
                    continue
                if not ids:
                    continue
                if len(ids) > 1:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                v, vid = held[0], ids[0]
                if least and metric == "euclidean":
                    squares, names, r_, out = (v * v).sum(1), some["id"].to_numpy(), some["r"].to_numpy(float), []
                    for i in range(0, len(x), NEAR):
                        q = x[i : i + NEAR]
                        r, c = _within(q, v, squares, r_[i : i + NEAR], 4 * least * len(q)) or np.nonzero(keep(_distances(q, v, metric)))
                        out.append(pd.DataFrame({"q": names[i : i + NEAR][r], "v": vid[c], "distance": _paired(q[r], v[c], metric)}))
                        if sum(map(len, out)) > HELD:
                            yield pd.concat(out)
                            out = []
                    if out:
                        yield pd.concat(out)
                    continue
                if few and metric == "manhattan":
                    names, reaches = some["id"].to_numpy(), some["r"].to_numpy(float) if least else None
                    for i in range(0, len(x), 4 * NEAR):
                        q = x[i : i + 4 * NEAR]
                        found = _coded(q, v, reaches[i : i + 4 * NEAR] if least else None, few, 16 * few * len(q))
                        if found is None:
                            near = [(j, *np.nonzero(keep(_distances(q[j : j + 16], v, metric)))) for j in range(0, len(q), 16)]
                            found = np.concatenate([a + j for j, a, _ in near]), np.concatenate([b for *_, b in near])
                        r, c = found
                        exact = _paired(q[r], v[c], metric)
                        if least:
                            inside = ~(exact > reaches[i : i + 4 * NEAR][r] + 1e-9)
                            r, c, exact = r[inside], c[inside], exact[inside]
                        yield pd.DataFrame({"q": names[i : i + 4 * NEAR][r], "v": vid[c], "distance": exact})
                    continue
                step = 256 if metric == "euclidean" else max(1, HELD // max(len(v), 1))
                for i in range(0, len(x), step):
                    q = x[i : i + step]
                    r, c = np.nonzero(keep(_distances(q, v, metric)))
                    exact = _paired(q[r], v[c], metric)
                    yield pd.DataFrame({"q": some["id"].to_numpy()[i : i + step][r], "v": vid[c], "distance": exact})

    return rows.mapInPandas(task, "q long, v long, distance double")


class Cover:
    """A ball cover of ``vectors(id, vec)``: pivots, and the size and radius of each cell, under a metric."""

    def __init__(self, vectors: DataFrame, seed: int = 0, metric: str = "euclidean") -> None:
        if metric not in METRICS:
            raise ValueError(f"metric is one of {METRICS}; for cosines give normalised vectors")
        self.metric = metric
        n = vectors.count()
        m = max(1, min(PIVOTS, math.isqrt(n) // 4))
        self.pivots = np.array([r.vec for r in vectors.select("vec", F.xxhash64("id", F.lit(seed)).alias("h")).orderBy("h").limit(m).collect()], dtype=float)
        self.n = n
        if not n:
            self.placed, self.size, self.radius = vectors.select("id", "vec", F.lit(0).alias("cell")), np.zeros(1), np.zeros(1)
            return
        pivots = self.pivots

        @F.pandas_udf("cell int, away double")
        def place(vec: pd.Series) -> pd.DataFrame:
            d = _distances(np.stack(vec.to_numpy()).astype(float), pivots, metric) if len(vec) else np.zeros((0, 1))
            return pd.DataFrame({"cell": d.argmin(axis=1).astype("int32") if len(d) else [], "away": d.min(axis=1) if len(d) else []})

        self.placed = cut(vectors.select("id", "vec", place("vec").alias("p")).select("id", "vec", "p.cell", "p.away"))
        rows = self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect()  # a row a pivot
        self.size, self.radius = np.zeros(len(pivots)), np.full(len(pivots), -np.inf)
        for r in rows:
            self.size[r.cell], self.radius[r.cell] = r.n, r.r
        # cells near to each other share a group, so that a query goes to it once however many of them it visits
        left, self.group, now = set(range(len(pivots))), np.zeros(len(pivots), dtype="int32"), -1
        while left:
            now, room, first = now + 1, GROUP, min(left)
            for c in sorted(left, key=lambda c: (float(_distances(pivots[first : first + 1], pivots[c : c + 1], metric)[0, 0]), c)):
                if c == first or self.size[c] <= room:
                    self.group[c] = now
                    left.discard(c)
                    room -= self.size[c]

    def grouped(self) -> DataFrame:
        """``cell, id, vec``: the rows by the group of their cell."""
        group = self.group
        of = F.pandas_udf(lambda cell: pd.Series(group[cell.to_numpy()]), "int")
        return self.placed.select(of("cell").alias("cell"), "id", "vec")

    def groups(self, cells: Callable[[np.ndarray, np.ndarray], list], but: Callable[[np.ndarray, np.ndarray], list] | None = None) -> Callable[[np.ndarray, np.ndarray], list]:
        """The groups of the cells that a function names, without those of the cells that ``but`` names."""
        group = self.group

        def of(x: np.ndarray, r: np.ndarray) -> list:
            found = [np.unique(group[c]) for c in cells(x, r)]
            return [np.setdiff1d(a, group[b]) for a, b in zip(found, but(x, r))] if but else found

        return of

    def visited(self, reach: float | None = None) -> Callable[[np.ndarray, np.ndarray], list]:
        """A function of query vectors and their reaches: the cells that may hold something within reach."""
        pivots, radius, metric = self.pivots, self.radius, self.metric

        def cells(x: np.ndarray, r: np.ndarray) -> list:
            d = _distances(x, pivots, metric)
            r = np.full(len(x), reach) if reach is not None else r
            near = (d - radius[None, :] <= r[:, None] + 1e-7) & (d - d.min(axis=1, keepdims=True) <= 2 * r[:, None] + 1e-7) & np.isfinite(radius)[None, :]
            return [np.flatnonzero(row).astype("int32") for row in near]

        return cells

    def asks(self, queries: DataFrame, cells: Callable[[np.ndarray, np.ndarray], list], reach: Column | float = 0.0) -> DataFrame:
        """``cell, id, vec``: the queries at every cell they visit."""

        @F.pandas_udf("array<int>")
        def at(vec: pd.Series, r: pd.Series) -> pd.Series:
            return pd.Series(cells(np.stack(vec.to_numpy()).astype(float), r.to_numpy(float)), dtype=object) if len(vec) else pd.Series([], dtype=object)

        reach = reach if isinstance(reach, Column) else F.lit(float(reach))
        return queries.select("id", "vec", reach.alias("r"), F.explode(at("vec", reach)).alias("cell"))


def _few(k: int) -> Callable[[np.ndarray], np.ndarray]:
    def near(d: np.ndarray) -> np.ndarray:
        m = min(k, d.shape[1])
        return d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m] + 1e-9

    near.k = k
    return near


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q").orderBy("distance", "v")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "v", "distance")


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, others: bool = True, cover: Cover | None = None, metric: str = "euclidean") -> DataFrame:
    """``q, rank, v, distance``: each query's ``k`` nearest of ``vectors(id, vec)``; ties go to the smaller id.

    With ``others`` a vector of the query's own id is left out. A query first
    asks the nearest cells that hold enough vectors, which bounds its reach,
    and then the other cells within that reach.
    """
    cover = cover or Cover(vectors, metric=metric)
    metric = cover.metric
    if not cover.n:
        return _best(_compared(cover.placed, queries.withColumn("cell", F.lit(0)), _few(k)), k)
    least, pivots, size = k + 1, cover.pivots, cover.size

    def home(x: np.ndarray, _: np.ndarray) -> list:
        order = np.argsort(_distances(x, pivots, metric), axis=1)
        upto = np.cumsum(size[order], axis=1)
        return [o[: int(np.searchsorted(u, min(least, u[-1]))) + 1].astype("int32") for o, u in zip(order, upto)]

    members = cover.grouped()
    mine = (lambda df: df.where("q <> v")) if others else (lambda df: df)
    first = cut(_best(mine(_compared(members, cover.asks(queries, cover.groups(home)), _few(k + 1), metric, GROUP)), k))
    reach = first.groupBy("q").agg(F.max("distance").alias("r"), F.count("*").alias("n"))
    asked = queries.join(reach, queries["id"] == reach["q"], "left").select("id", "vec", F.when(F.col("n") >= k, F.col("r")).otherwise(float("inf")).alias("r"))
    within = cover.visited()
    rest = cover.groups(lambda x, r: within(x, np.where(np.isfinite(r), r, 1e300)), home)
    more = mine(_compared(members, cover.asks(asked, rest, F.col("r")), _few(k + 1), metric, GROUP, least))
    return _best(first.select("q", "v", "distance").unionByName(more), k)


def nearest(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """``q, rank, v, distance`` between two tables with ``id`` and ``features``."""
    side = lambda df: df.select("id", F.col("features").alias("vec"))
    return knn_join(side(queries), side(train), k, others=False)


def kth_neighbour_stats(vectors: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """``mean, deviation, least, largest`` of the distance to the ``k``-th nearest other row."""
    far = knn_join(vectors, vectors, k, metric=metric).where(F.col("rank") == k)
    return far.agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("deviation"), F.min("distance").alias("least"), F.max("distance").alias("largest"))


def range_join(queries: DataFrame, vectors: DataFrame, radius: float, cover: Cover | None = None, metric: str = "euclidean") -> DataFrame:
    """``q, v, distance`` of all pairs within ``radius``, each row with itself too."""
    cover = cover or Cover(vectors, metric=metric)
    if not cover.n:
        return _compared(cover.placed, queries.withColumn("cell", F.lit(0)), lambda d: d <= radius)
    asks = cover.asks(queries, cover.groups(cover.visited(radius)))
    return _compared(cover.grouped(), asks, lambda d: d <= radius + 1e-9, cover.metric, GROUP).where(F.col("distance") <= radius)


def _buckets(vectors: DataFrame, tables: int, bucket: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``cell, id, vec``: every vector in its bucket of every table."""

    @F.pandas_udf("array<long>")
    def at(vec: pd.Series) -> pd.Series:
        if not len(vec):
            return pd.Series([], dtype=object)
        x = np.stack(vec.to_numpy()).astype(float)
        return pd.Series(list(np.stack([bucket(x, t) for t in range(tables)], axis=1)), dtype=object)

    return vectors.select("id", "vec", F.explode(at("vec")).alias("cell"))


def _folded(codes: np.ndarray, table: int) -> np.ndarray:
    """One number of a row of integer codes."""
    out = np.full(len(codes), 1469598103934665603 + table, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            out = (out ^ codes[:, j].astype(np.int64).view(np.uint64)) * np.uint64(1099511628211)
    return out.view(np.int64)


def _dims(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vec")).first()
    return int(row[0]) if row else 1


def hashed_range_join(queries: DataFrame, vectors: DataFrame, radius: float, tables: int = 8, hashes: int = 4, width: float = 4.0, seed: int = 0) -> DataFrame:
    """``q, v, distance`` of most pairs within ``radius``: those that share a bucket of Euclidean hashes (E2LSH).

    A hash is a random projection cut into steps of ``width`` times the radius.
    Every pair returned is within the radius; the share found grows with ``tables``.
    """
    d, rnd = _dims(vectors), np.random.default_rng(seed)
    w, b = rnd.normal(size=(tables, d, hashes)), rnd.uniform(0, width * radius, (tables, hashes))
    bucket = lambda x, t: _folded(np.floor((x @ w[t] + b[t]) / (width * radius)), t)
    found = _compared(_buckets(vectors, tables, bucket), _buckets(queries, tables, bucket), lambda m: m <= radius + 1e-9)
    return found.where(F.col("distance") <= radius).distinct()


def hashed_knn_join(queries: DataFrame, vectors: DataFrame, k: int, tables: int = 8, bits: int = 8, seed: int = 0) -> DataFrame:
    """``q, rank, v, distance``: the nearest among vectors with equal signs of random projections in some table."""
    d, rnd = _dims(vectors), np.random.default_rng(seed)
    w = rnd.normal(size=(tables, d, bits))
    bucket = lambda x, t: _folded(x @ w[t] > 0, t)
    found = _compared(_buckets(vectors, tables, bucket), _buckets(queries, tables, bucket), _few(k + 1))
    return _best(found.where("q <> v").distinct(), k)


def ball_cover_one_shot(queries: DataFrame, vectors: DataFrame, k: int, cells: int = 3) -> DataFrame:
    """``q, rank, v, distance`` from each query's ``cells`` nearest cells of the cover only: fast and approximate."""
    cover = Cover(vectors)
    pivots = cover.pivots
    near = lambda x, _: list(np.argsort(_distances(x, pivots), axis=1)[:, :cells].astype("int32"))
    return _best(_compared(cover.placed.select("cell", "id", "vec"), cover.asks(queries, near), _few(k + 1)).where("q <> v"), k)


def local_outlier_factor(vectors: DataFrame, k: int) -> DataFrame:
    """``id, lof`` over the exact ``k`` nearest neighbours."""
    near = cut(knn_join(vectors, vectors, k))
    radius = near.groupBy("q").agg(F.max("distance").alias("radius"))
    reach = near.join(radius.select(F.col("q").alias("v"), "radius"), "v").withColumn("reach", F.greatest("radius", "distance"))
    density = reach.groupBy("q").agg((F.lit(1.0) / F.avg("reach")).alias("lrd"))
    of = near.join(density.select(F.col("q").alias("v"), F.col("lrd").alias("other")), "v").join(density, "q")
    return of.groupBy(F.col("q").alias("id")).agg((F.avg("other") / F.first("lrd")).alias("lof"))


def dbscan(vectors: DataFrame, radius: float, least: int) -> DataFrame:
    """``id, cluster``: the smallest core id of the cluster, -1 for noise; a point is its own neighbour.

    A border point goes to the cluster of its smallest core neighbour.
    """
    from statloom.plans.graph import connected_components

    near = cut(range_join(vectors, vectors, radius).select("q", "v"))
    core = cut(near.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("q"))
    edges = near.join(core, "q", "left_semi").join(core.select(F.col("q").alias("v")), "v", "left_semi")
    comps = cut(connected_components(edges, "q", "v"))
    border = near.join(comps.select(F.col("node").alias("v"), "component"), "v").groupBy("q").agg(F.min_by("component", "v").alias("border"))
    own = comps.select(F.col("node").alias("q"), F.col("component"))
    all_ = vectors.select(F.col("id").alias("q")).join(own, "q", "left").join(border, "q", "left")
    return all_.select(F.col("q").alias("id"), F.coalesce("component", "border", F.lit(-1)).cast("long").alias("cluster"))
