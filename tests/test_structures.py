"""Registered queries without SQL against brute force over the whole table."""

import numpy as np
import pandas as pd

from statloom import queries_structures as Q
from statloom.models.dual import solve_pairs
from statloom.models.online import rbf
from statloom.operators import clustering as K
from tests.test_hierarchy import brute_condensed, partition


def vectors(sf):
    x = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    return x["vec_id"].to_numpy(), np.stack(x["embedding"]).astype(float), x["label"].to_numpy()


def test_projection_index_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    ids, x, _ = vectors(sf)
    got = {}
    for r in Q.projection_index_neighbours(spark, sf).collect():
        got.setdefault(r.q, []).append(r.v)
    assert sorted(got) == [i for i in ids if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        d = ((x - x[ids == q]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hits += len(set(found) & set(ids[np.argsort(d)[:5]]))
    assert hits >= 0.9 * 5 * len(got)


def test_ward_linkage(spark, sf):
    ids, x, _ = vectors(sf)
    want = K._cut_tree(len(x), K.merges(x, np.ones(len(x)), "ward"), 10)
    assert partition({r.id: r.cluster for r in Q.ward_linkage(spark, sf).collect()}) == partition(dict(zip(ids.tolist(), want.tolist())))


def test_hdbscan_clusters(spark, sf):
    ids, x, _ = vectors(sf)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :12]
    core = np.sort(d, axis=1)[:, 3]
    edges = {(min(i, j), max(i, j)): max(d[i, j], core[i], core[j]) for i in range(len(x)) for j in near[i].tolist()}
    label, _ = brute_condensed([(w, int(ids[a]), int(ids[b])) for (a, b), w in edges.items()], 5)
    assert {r.id: r.cluster for r in Q.hdbscan_clusters(spark, sf).collect() if r.cluster >= 0} == label


def test_dual_machine(spark, sf):
    ids, x, label = vectors(sf)
    y = np.where(label <= np.quantile(label, 1 / 3), 1.0, -1.0)
    k = rbf(1.0)(x, x)
    alpha = solve_pairs(k, y, -np.ones(len(y)), np.zeros(len(y)), np.ones(len(y)), 1e-7)
    f = k @ (alpha * y)
    free = (alpha > 0) & (alpha < 1)
    want = f + (y - f)[free].mean()
    got = {r.id: r.decision for r in Q.dual_machine(spark, sf).collect()}
    assert np.allclose([got[i] for i in ids.tolist()], want, atol=0.03)


def test_optics_ordering(spark, sf):
    ids, x, _ = vectors(sf)
    rows = Q.optics_ordering(spark, sf).collect()
    assert sorted(r.position for r in rows) == list(range(len(ids))) and sorted(r.id for r in rows) == ids.tolist()
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    core = np.sort(d, axis=1)[:, 4]  # itself and the fourth other
    at = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(r.core - core[at[r.id]]) < 1e-5 for r in rows)
    assert all(r.reach is None or r.reach >= r.core - 1e-6 for r in rows)


def test_isomap_positions(spark, sf):
    ids, _, _ = vectors(sf)
    rows = Q.isomap_positions(spark, sf).collect()
    assert sorted(r.id for r in rows) == ids.tolist()
    assert np.std([r.x0 for r in rows]) > np.std([r.x1 for r in rows]) > 0


def test_stream_adwin(spark, sf):
    from statloom import queries_text

    assert sorted(map(tuple, queries_text.stream_adwin(spark, sf).collect())) == sorted(map(tuple, queries_text.adwin_drift(spark, sf).collect()))
