"""Exact top-k by inner product, by an impact-ordered index read score at a time.

Vectors become integers. Each block of vectors keeps, for every component and
sign, a list of its vectors by descending quantised size: segments of equal
level. A query reads the segments of all its components in bands of falling
impact (its own component times the level), adds what each vector gains, and
knows after every band that an unread posting adds no more than the band's
threshold. It stops once that proves that all but a few vectors of the block
stay below the ``top``-th best exact score seen; those few, which may be all
where nothing can be proved, are scored exactly.

Every group of queries meets every block, so the sizes of both set how often
rows are copied: about the product of both tables over a block's size. Both are dealt by row
number, whatever ids or values repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.llm._memory import trimmed
from statloom.plans.lineage import cut

#: Levels of quantised impact a sign.
LEVELS = 32
#: Least and most vectors of a block on average; between them a 16th of all. The same for the queries that meet it at a time.
LEAST, MOST = 8_192, 65_536
LEAST_ASKED = 512
#: Bands of impact: each ends at half the threshold of the one before, the last at nothing.
BANDS = 6
#: Possible members that are rescored instead of reading on.
FEW = 64
#: Products beyond this are not exact as doubles; such blocks and queries are scored in whole numbers of any size.
EXACT = 1 << 52


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as 64-bit integers or, where those or doubles lack, as Python's."""
    big = np.abs(x).max(initial=0.0)
    if big * scale < EXACT:
        return np.floor(scale * x).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= EXACT else int(np.floor(v * scale)) for v in row] for row in x], dtype=object)


class ImpactIndex:
    """The postings of a block of integer vectors, by component, sign and descending level."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.most = max((abs(int(v.max())), abs(int(v.min()))), default=0) if v.size else 0
        self.plain = v.dtype != object and self.most < 1 << 26
        if not self.plain:
            return
        self.step = max(1, -(-self.most // LEVELS))
        self.lists: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        self.upto: dict[int, np.ndarray] = {}
        for sign in (1, -1):
            level = np.maximum(-((-sign * v) // self.step), 0)  # rounded up, so that a level bounds its vectors
            held, size, upto = [], [], np.zeros((v.shape[1], LEVELS + 2), dtype=np.int64)
            for d in range(v.shape[1]):
                order = np.argsort(-level[:, d], kind="stable")
                held.append(order[: np.count_nonzero(level[:, d])].astype(np.int32))
                size.append((level[held[-1], d] * self.step).astype(np.float64))
                upto[d] = np.bincount(level[held[-1], d], minlength=LEVELS + 2)[::-1].cumsum()[::-1]  # postings of a level or more
            self.lists[sign], self.upto[sign] = (held, size), upto

    def _scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.v[rows] @ q

    def possible(self, q: np.ndarray, others: np.ndarray, top: int) -> tuple[np.ndarray, float]:
        """Rows among which the ``top`` best others are, and the share of postings read to prove it."""
        everyone = np.flatnonzero(others)
        if not self.plain or q.dtype == object or len(everyone) <= top or float(self.most) * float(np.abs(q).max()) * len(q) >= EXACT:
            return everyone, 0.0
        weight, signs = np.abs(q), np.sign(q)
        dims = [d for d in np.flatnonzero(weight).tolist() if self.upto[signs[d]][d, 1]]
        if not dims:  # nothing gains anything, so nothing is above the others
            return everyone, 0.0
        weight = weight[dims].astype(np.float64)
        held, size = ([self.lists[signs[d]][i][d] for d in dims] for i in (0, 1))
        upto = np.array([self.upto[signs[d]][d] for d in dims]).reshape(len(dims), -1)
        reach = weight * np.array([x[0] for x in size])
        done, total = np.zeros(len(dims), dtype=np.int64), max(int(upto[:, 1].sum()), 1)
        gained, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), dtype=np.int64)
        slack, few, least = 1e-9 * reach.sum() + 1e-6, min(2 * top, len(everyone)), -np.inf
        for band in range(1, BANDS + 1):
            limit = 0.0 if band == BANDS else reach.max(initial=0.0) / 2**band
            level = np.minimum(np.floor(limit / (weight * self.step)).astype(np.int64) + 1, LEVELS + 1)
            to = upto[np.arange(len(dims)), level]
            some = np.flatnonzero(to > done).tolist()
            if some:
                rows = np.concatenate([held[i][done[i] : to[i]] for i in some])
                gains = np.concatenate([size[i][done[i] : to[i]] for i in some]) * np.repeat(weight[some], (to - done)[some])
                gained += np.bincount(rows, weights=gains, minlength=len(gained))
                seen += np.bincount(rows, minlength=len(seen))
            done = np.maximum(done, to)
            unread = np.minimum(limit, reach).sum()  # an unread posting gains ``limit`` at most, so a vector at least has this bound
            if band > 1 and band < BANDS and unread > least:
                continue
            bound = gained - limit * seen + unread
            bound[~others] = -np.inf
            best = np.argpartition(-bound, few - 1)[:few]
            least = max(least, np.partition(self._scores(best, q), -top)[-top])
            left = np.flatnonzero(bound >= least - slack)
            if len(left) <= FEW or band == BANDS:
                return left, float(done.sum() / total)
        raise AssertionError("the last band returns")

    def top(self, q_id: int, q: np.ndarray, top: int) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the ``top`` best others, best first, ties to the smaller id."""
        left, _ = self.possible(q, self.ids != q_id, top)
        if self.v.dtype == object or q.dtype == object or float(self.most) * float(np.abs(q).max(initial=0)) * len(q) >= EXACT:
            scores = self.v[left].astype(object) @ q.astype(object) if len(left) else np.zeros(0, dtype=object)
        else:
            scores = self._scores(left, q)
        order = sorted(range(len(left)), key=lambda i: (-scores[i], self.ids[left[i]]))[:top] if scores.dtype == object else np.lexsort((self.ids[left], -scores))[:top]
        return self.ids[left[order]], [max(min(int(scores[i]), (1 << 63) - 1), -(1 << 63)) for i in order]


def usable(vec: Column) -> Column:
    """Not null, not empty, every component finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))


def top_products(vectors: DataFrame, is_query: Column, top: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` highest inner products of ``floor(scale * x)`` components.

    All candidates are answered where there are fewer; ties go to the smaller
    vec_id. Vectors that are null, empty or hold a null or non-finite
    component, rows without an id, and vectors of another length than the most
    frequent (of equals the smallest) take no part; zero vectors do. Rows that
    repeat an id are candidates each, never for a query of that id; such a
    query is asked once, with the least of its vectors. Scores beyond a long are
    ranked exactly and given as the nearest long. An empty table, and a table
    of one vector, give no rows. Other columns are ignored.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    x = x.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = x.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return x.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    dims, n = lengths
    x = x.where(F.size("v") == dims)
    asked = cut(x.where("asks").groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = -(-n // max(LEAST, min(MOST, n // 16)))
    n_asked = asked.count()
    groups = max(1, -(-n_asked // max(LEAST_ASKED, min(MOST, n_asked // 16))))
    dealt = lambda k: F.pmod(F.monotonically_increasing_id(), F.lit(k))
    spread = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    stored = x.select(dealt(blocks).alias("block"), F.lit(0).alias("kind"), "vec_id", "v").withColumn("grp", spread(groups))
    asked = asked.select(dealt(groups).alias("grp"), F.lit(1).alias("kind"), "vec_id", "v").withColumn("block", spread(blocks))
    rows = stored.unionByName(asked).withColumn("tile", F.col("block") * groups + F.col("grp")).drop("block", "grp")
    rows = rows.repartitionByRange(blocks * groups, "tile").sortWithinPartitions("tile", "kind")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, index = None, [], [], None
        for batch in batches:
            keys = batch[["tile", "kind"]].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for first, last in zip(edges, edges[1:]):
                if first == last:
                    continue
                tile, kind = keys[first]
                if tile != at:
                    at, ids, held, index = tile, [], [], None
                some = batch.iloc[first:last]
                if kind == 0:
                    ids.append(some["vec_id"].to_numpy())
                    held.append(np.stack(some["v"]))
                elif ids:
                    if index is None:
                        index, held = ImpactIndex(np.concatenate(ids), whole(np.concatenate(held), scale)), []
                    out = []
                    for q_id, q in zip(some["vec_id"].tolist(), some["v"]):
                        found, scores = index.top(q_id, whole(q[None, :], scale)[0], top)
                        out += [(q_id, i, s) for i, s in zip(found.tolist(), scores)]
                    if out:
                        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = rows.mapInPandas(trimmed(answer), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
