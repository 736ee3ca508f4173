"""Approximate nearest neighbours with learned partitions.

On a bounded sample: the graph of nearest neighbours is partitioned so that
parts are of like size and cut few edges, and a linear softmax classifier
learns the part of a vector. Every vector of the table is then indexed under
its most probable part, and a query goes to its most probable parts. How many
is measured on the sample: the fewest that reach the wanted recall there, so
data without structure costs more and is not answered worse.

Parts are stored in blocks of bounded size (a part with a third of all vectors
has more blocks), and each block ranks its vectors for the queries that came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.plans.lineage import cut

#: Vectors that the index is fitted on at most.
SAMPLE = 4_096
#: The least and the most parts; between them a quarter of the root of the number of vectors.
LEAST_PARTS, MOST_PARTS = 2, 128
#: Vectors of a block on average.
BLOCK = 4_096
#: Neighbours in the sample's graph.
EDGES = 10


@dataclass
class Router:
    """Linear scores of the parts and how many of them a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ self.weights + self.bias), axis=1, kind="stable")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, their largest component between a half and one: exact, and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest others of every row, a few rows at a time."""
    out = []
    for i in range(0, len(x), 128):
        s = -(x[i : i + 128] @ x.T)
        s[np.arange(len(s)), np.arange(i, i + len(s))] = np.inf
        out.append(np.argpartition(s, k - 1, axis=1)[:, :k].astype(np.int32))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """Parts of like size: halving along main directions, then moves that cut fewer edges."""
    n = len(x)
    label = np.zeros(n, dtype=np.int64)
    made = 1
    while made < parts:
        sizes = np.bincount(label, minlength=made)
        rows = np.flatnonzero(label == int(sizes.argmax()))
        inner = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(inner.T @ inner)[1][:, -1]
        label[rows[np.argsort(inner @ axis, kind="stable")[len(rows) // 2 :]]] = made
        made += 1
    room = int(np.ceil(1.1 * n / parts))
    both = [[] for _ in range(n)]
    for i, near in enumerate(graph):
        for j in near:
            both[i].append(j)
            both[j].append(i)
    sizes = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(label[both[i]], minlength=parts)
            votes[(sizes >= room) & (np.arange(parts) != label[i])] = -1
            to = int(votes.argmax())
            if votes[to] > votes[label[i]]:
                sizes[label[i]] -= 1
                sizes[to] += 1
                label[i] = to
                moved += 1
        if moved < n // 200:
            break
    return label


def fit(sample: np.ndarray, parts: int, top: int, recall: float) -> Router:
    """Fit the router; ``recall`` of the ``top`` neighbours within the sample is its aim."""
    x = _unit(sample)
    k = min(EDGES, len(x) - 1)
    parts = min(parts, len(x) // 2)
    if parts < 2 or k < 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), 1)
    graph = _nearest(x, k)
    label = balanced_parts(x, graph, parts)
    aim = np.zeros((len(x), parts))
    aim[np.arange(len(x)), label] = 1
    spread = np.stack([np.bincount(label[near], minlength=parts) for near in graph]) / k
    aim = 0.5 * aim + 0.5 * spread
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    m, v = np.zeros((x.shape[1] + 1, parts)), np.zeros((x.shape[1] + 1, parts))
    for t in range(1, 121):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        e = (p / p.sum(axis=1, keepdims=True) - aim) / len(x)
        g = np.vstack((x.T @ e, e.sum(axis=0, keepdims=True)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    router = Router(w, b, parts)
    order = router.order(x)
    home, rank = order[:, 0], np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(x), 0), axis=1)
    near = _nearest(x, min(top, k))
    at = np.take_along_axis(rank, home[near], axis=1)  # when the query visits each neighbour's part
    found = np.array([(at < p).mean() for p in range(1, parts + 1)])
    router.probes = int(np.argmax(found >= recall) + 1) if (found >= recall).any() else parts
    return router


def usable(vec: Column) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def _cosine(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, summed one component after the other: equal rows, equal results. Powers of two cancel."""
    q, c = _scaled(q), _scaled(c)
    dot, qq, cc = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c))
    for j in range(c.shape[1]):
        dot += q[:, j] * c[:, j]
        qq += q[:, j] * q[:, j]
        cc += c[:, j] * c[:, j]
    return dot / (np.sqrt(qq) * np.sqrt(cc))


def search(vectors: DataFrame, is_query: Column, top: int = 5, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``top`` nearest by cosine.

    Vectors that are null, empty, zero or hold a null or non-finite component,
    rows without an id, and vectors of another length than the most frequent (of
    equals the smallest) take no part. Ties go to the smaller vec_id. Rows that repeat an id
    are candidates each; such a query is asked once, with the least of its vectors. Finite
    vectors of any size are compared by their directions. An empty table, and a
    table of one vector, give no rows. Other columns are ignored.
    """
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    x = x.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = x.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return x.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dims, n = lengths
    x = x.where(F.size("v") == dims)
    parts = max(LEAST_PARTS, min(MOST_PARTS, math.isqrt(n) // 4))
    sample = x.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["v"]
    router = fit(np.stack(sample), parts, top, recall)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                order = router.order(_unit(np.stack(batch["v"])))
                likely = [list(o) if asks else [] for o, asks in zip(order, batch["asks"])]
                yield batch.assign(part=order[:, 0].astype(np.int32), likely=likely)

    indexed = cut(x.mapInPandas(index, "vec_id long, v array<double>, asks boolean, part int, likely array<int>"))
    blocks = cut(indexed.groupBy("part").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # one row a part
    sizes = {r["part"]: r["size"] for r in blocks.collect()}
    size = F.array(*[F.lit(sizes.get(i, 0)).cast("long") for i in range(len(router.bias))])
    upto = lambda i: F.aggregate(F.slice("likely", F.lit(1), i), F.lit(0).cast("long"), lambda a, p: a + F.element_at(size, p + 1))
    enough = F.get(F.filter(F.sequence(F.lit(1), F.size("likely")), lambda i: upto(i) > top), F.lit(0))  # parts that hold others than the query
    probes = F.slice("likely", F.lit(1), F.greatest(F.coalesce(enough, F.size("likely")), F.lit(router.probes)))
    spread = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    blocks = blocks.select("part", "blocks")
    stored = indexed.join(F.broadcast(blocks), "part").select("part", spread.alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    once = indexed.where("asks").groupBy("vec_id").agg(F.min(F.struct("v", "likely")).alias("least")).select("vec_id", "least.*")
    asked = once.select("vec_id", "v", F.explode(probes).alias("part"))
    asked = asked.join(F.broadcast(blocks), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = stored.unionByName(asked.select("part", "block", F.lit(1).alias("kind"), "vec_id", "v"))
    rows = rows.repartition("part", "block").sortWithinPartitions("part", "block", "kind", "vec_id")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, held, unit = None, [], [], None
        for batch in batches:
            keys = list(zip(batch["part"].tolist(), batch["block"].tolist(), batch["kind"].tolist()))
            first = 0
            while first < len(keys):
                last = first
                while last < len(keys) and keys[last] == keys[first]:
                    last += 1
                part, block, kind = keys[first]
                some = batch.iloc[first:last]
                if (part, block) != at:
                    at, ids, held, unit = (part, block), [], [], None
                if kind == 0:
                    ids.append(some["vec_id"].to_numpy())
                    held.append(np.stack(some["v"]))
                elif ids:
                    if unit is None:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                        unit = _unit(held[0])
                    out = []
                    for i in range(0, len(some), 256):
                        q_ids, q = some["vec_id"].to_numpy()[i : i + 256], np.stack(some["v"].iloc[i : i + 256])
                        near = _unit(q) @ unit.T
                        near[q_ids[:, None] == ids[0][None, :]] = -np.inf
                        k = min(top, near.shape[1])
                        floor = np.partition(near, near.shape[1] - k, axis=1)[:, -k] - 1e-9
                        a, b = np.nonzero((near >= floor[:, None]) & np.isfinite(near))
                        score = _cosine(q[a], held[0][b])
                        for j in np.unique(a):
                            mine = np.flatnonzero(a == j)
                            mine = mine[np.lexsort((ids[0][b[mine]], -score[mine]))][:top]
                            out.append(pd.DataFrame({"query_id": q_ids[j], "vec_id": ids[0][b[mine]], "score": score[mine]}))
                    if out:
                        yield pd.concat(out, ignore_index=True)
                first = last

    found = rows.mapInPandas(rank, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
