"""What larger and odd tables brought to light."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.operators import clustering as K
from statloom.operators import hierarchy as H
from statloom.operators import neighbors as N
from statloom.operators import terms
from statloom.queries import ORACLE_SQL, QUERIES
from statloom.sources import corpus
from tests.compare import same
from tests.test_hierarchy import partition


def test_one_dependence_of_repeated_keys(spark, sf, tmp_path):
    duckdb.execute(f"COPY (SELECT c_custkey % 40 c_custkey, * EXCLUDE (c_custkey) FROM '{sf}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    same(QUERIES["one_dependence"](spark, str(tmp_path)), ORACLE_SQL["one_dependence"], str(tmp_path))


@pytest.mark.parametrize("linkage", ["average", "complete", "ward"])
def test_rounds_over_vectors(spark, linkage, monkeypatch):
    """Several tiles and rounds; distances are never a table of pairs."""
    monkeypatch.setattr(H, "LAST", 12)
    monkeypatch.setattr(H, "TILE", 32)
    monkeypatch.setattr(K, "all_distances", None)
    x = np.random.default_rng(6).normal(size=(80, 4))
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    want = K._cut_tree(80, K.merges(x, np.ones(80), linkage), 10)
    got = {r.id: r.cluster for r in K.hierarchical(df, 10, linkage).collect()}
    assert partition(got) == partition({3 * i: c for i, c in enumerate(want.tolist())})


@pytest.mark.parametrize("linkage", ["average", "complete", "ward"])
def test_many_rows_store_no_square(spark, linkage, monkeypatch):  # F1, F2 and F4 of round 5
    """The square of the rows was stored at the start, 80 GB for 100,000 rows."""
    for name, value in (("SQUARE", 90), ("LAST", 40), ("TILE", 16), ("SENT", 100)):
        monkeypatch.setattr(H, name, value)
    monkeypatch.setattr(H, "_from_vectors", None)
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(130, 4)), rng.normal(size=(40, 4)) * 0.05 + 2, np.zeros((20, 4))]) + 50  # a large cluster and one of equals
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(1, None)], "id long, vec array<double>").repartition(3)
    want = K.merges(x, np.ones(len(x)), linkage)
    tree = H.agglomerate(df, linkage, vectors=True).collect()
    assert sorted(r.height for r in tree) == pytest.approx(sorted(h for *_, h in want), abs=1e-6) and max(r.size for r in tree) == len(x)
    for k in (10, 60):
        got = {r.id: r.cluster for r in K.hierarchical(df, k, linkage).collect() if r.id != 1}
        assert partition(got) == partition({3 * i: c for i, c in enumerate(K._cut_tree(len(x), want, k).tolist())})


def test_single_linkage_forms_near_pairs_only(spark, sf, monkeypatch):
    monkeypatch.setattr(K, "all_distances", None)
    same(QUERIES["single_linkage_below"](spark, sf), ORACLE_SQL["single_linkage_below"], sf)


def test_medoid_in_tiles(spark, monkeypatch):
    """No more than a tile's rows meet at once, and no row is left out beforehand."""
    monkeypatch.setattr(K, "SIDE", 64)
    x = np.random.default_rng(2).normal(size=(300, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    means = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).mean(axis=1)
    i, d = K.medoid(df)
    assert i == int(means.argmin()) and abs(d - means.min()) < 1e-6


def test_neighbour_joins_ask_groups_once(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 200)
    x = np.random.default_rng(3).normal(size=(1500, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    cover = N.Cover(df)
    asked = cover.asks(df, cover.groups(cover.visited(9.0)))
    assert len(set(cover.group)) < len(cover.pivots)
    assert asked.count() == asked.distinct().count() == 1500 * len(set(cover.group))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert {(r.q, r.rank): r.v for r in N.knn_join(df, df, 3, cover=cover).collect()} == {(i, j + 1): int(near[i, j]) for i in range(1500) for j in range(3)}


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_key_are_counted_together_and_weighed_without_sorts(spark):  # F13, F14, F17
    docs = spark.createDataFrame([(1, "b a b"), (1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    counts = terms.term_counts(docs, "doc_id", "text", unique=True)
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "b", 2), (2, "a", 1)]
    assert "SortMergeJoin" not in _plan(terms.tf_idf(counts, 3, "log"))


def test_hashed_vectors_shuffle_texts_and_no_counts(spark):  # F19
    docs = spark.createDataFrame([(1, "b a b"), (2, "a")], "doc_id long, text string")
    got = corpus.hashed_vectors(docs, "doc_id", idf=True)
    assert {r.doc_id: sorted(round(v, 6) for v in r.vec.values()) for r in got.collect()} == {1: [0.0, 1.386294], 2: [0.0]}
    assert "SortMergeJoin" not in _plan(got) and not re.search(r"hashpartitioning\(doc_id#\d+L?, [^\d]", _plan(got))


def test_corpus_vectors_of_every_document(spark, tmp_path):  # F6 of round 5
    """Only the lengths of the vectors were given, and none for documents without tokens."""
    texts = {1: "b a b", 2: "a c", 3: " - ", 4: None, 5: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    at = {w: spark.range(1).select(corpus.bucket(F.lit(w), 1 << 18)).first()[0] for w in "abc"}
    idf = {"a": np.log(5 / 2), "b": np.log(5), "c": np.log(5)}
    got = {r.doc_id: r for r in QUERIES["corpus_vectors"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for i, text in texts.items():
        words = re.findall(r"\w+", text or "")
        want = sorted((at[w], round(words.count(w) * idf[w], 6)) for w in set(words))
        assert list(zip(got[i]["columns"], got[i].weights)) == want and got[i].n == len(want)


def test_totals_tell_no_document_from_another(spark):  # F26
    docs = spark.createDataFrame([(1, "b a b"), (1, "a"), (2, None)], "doc_id long, text string")
    got = terms.totals(docs, "text")
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("b", 2)]
    assert "doc_id" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]


def test_moments_of_few_features_need_no_python(spark, monkeypatch):
    """Two Python workers a task stood one behind the other where a transform's result was summed."""
    from statloom.operators import features

    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3)) + 1e6
    df = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3)
    want = features._moments(df)
    assert np.allclose(want[0], x.mean(axis=0)) and np.allclose(want[1], np.cov(x.T, bias=True)) and want[2] == 500
    monkeypatch.setattr(features, "COLUMNS", 0)
    assert np.allclose(features._moments(df)[1], want[1])
    monkeypatch.undo()
    monkeypatch.setattr(features, "array_sum", None)
    features._moments(df)
    mean, cov, n = features._moments(df.limit(0))
    assert n == 1.0 and not cov.size


def test_training_tables_come_in_bounded_parts(spark, monkeypatch):
    """A task read its whole part of the training table each round, however many rows the file's part held."""
    from statloom.models import base

    df = spark.range(0, 20_000, 1, 1).select(F.array(F.rand(1), F.rand(2)).alias("features"), (F.rand(3) > 0.5).cast("double").alias("label"))
    assert base.parted(df).rdd.getNumPartitions() == 1
    monkeypatch.setattr(base, "ROWS", 500)
    got = [r.n for r in base.parted(df).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(got) == 40 and sum(got) == 20_000 and max(got) <= 550
    seen = []
    monkeypatch.setattr(base, "parted", lambda x: seen.append(1) or x)
    base.decision_tree(2).fit(df)
    assert seen


def test_ensembles_fit_equal_rows_once(spark, monkeypatch):  # F12
    """Each round of each ensemble went through all rows, however few kinds of them there were."""
    from statloom.models import base, ensemble, trees
    from statloom.plans.lineage import cut

    a, b = F.col("id") % 5, (F.col("id") / 5).cast("long") % 3
    df = cut(spark.range(0, 3_000, 1, 2).select("id", F.array(a.cast("double"), b.cast("double")).alias("features"), (F.xxhash64("id") % 10 < a + b - 2).cast("double").alias("label")))
    tree, at = base.decision_tree(depth=2), df.select("features").distinct()
    for one in (ensemble.Bagging(tree, 2), ensemble.Wagging(tree, 2), ensemble.AdaBoost(tree, 2), ensemble.ArcX4(tree, 2), ensemble.LogitBoost(base.regression_tree(depth=2), 2), ensemble.Stacking([tree], base.logistic(), folds=2), trees.ExtraTrees(2, 3, 2)):
        got, seen = [], []
        for copies in (base.COPIES, 10**9):  # equal rows as one, and every row
            monkeypatch.setattr(base, "parted", lambda x: seen.append(x.count()) or x)
            monkeypatch.setattr(base, "COPIES", copies)
            rows = one.fit(df).transform(at).collect()
            monkeypatch.undo()
            got.append({tuple(r.features): (r.prediction, [round(p, 4) for p in r.probability]) for r in rows})
        assert got[0] == got[1] and len(got[0]) == 15
        few = seen[: len(seen) // 2]
        assert all(n <= 60 for n in few) and all(n > 1_000 for n in seen[len(few):])
    assert base.condensed(df, [base.random_forest(2)], {}) is None and base.condensed(df, [base.decision_tree(least=2)], {}) is None


def test_second_pass_takes_what_lies_within_reach(spark, monkeypatch):  # F15
    """Every block gave each query its nearest by a partial sort, though the first pass had bounded its reach."""
    from statloom.operators import neighbors as N

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 3)) + 1e3
    found = N._within(v[:20], v, (v * v).sum(1), np.full(20, 0.5), 10**6)
    d = np.sqrt(((v[:20, None] - v[None]) ** 2).sum(2))
    assert {(i, j) for i, j in zip(*map(np.ndarray.tolist, found))} >= {(i, j) for i, j in zip(*np.nonzero(d <= 0.5))}
    assert N._within(v[:20], v, (v * v).sum(1), np.full(20, np.inf), 100) is None
    odd = np.vstack([v, np.full((1, 3), np.nan)])  # costs no other row its neighbours
    assert [x.tolist() for x in N._within(v[:20], odd, (odd * odd).sum(1), np.full(20, 0.5), 10**6)] == [found[0].tolist(), found[1].tolist()]
    monkeypatch.setattr(N, "GROUP", 150)
    for x in (rng.normal(size=(1_200, 4)), np.repeat(rng.normal(size=(40, 4)), 30, axis=0)):  # the second has large groups of equals
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
        away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(away, np.inf)
        near = np.argsort(away, axis=1, kind="stable")[:, :4]
        assert {(r.q, r["rank"]): r.v for r in N.knn_join(df, df, 4).collect()} == {(i, j + 1): int(near[i, j]) for i in range(len(x)) for j in range(4)}


def test_city_block_neighbours_by_rounded_vectors(spark, monkeypatch):  # F5 of round 5
    """Every pair of every block went through distances of 64 bits and a partial sort, whatever reach the first pass had found."""
    from statloom.operators import neighbors as N

    rng = np.random.default_rng(9)
    monkeypatch.setattr(N, "GROUP", 150)
    coded = N._coded
    x = rng.normal(size=(700, 6)) + 100
    away = np.abs(x[:, None] - x[None]).sum(axis=2)
    for r in (None, np.full(50, 3.0)):
        a, b = coded(x[:50], x, r, 5, 10**6)
        top = np.sort(away[:50], axis=1)[:, 4:5] if r is None else 3.0
        assert set(zip(a.tolist(), b.tolist())) >= set(zip(*map(np.ndarray.tolist, np.nonzero(away[:50] <= top))))
        assert len(a) < 50 * 30
    assert coded(x[:50], x, np.full(50, np.inf), 5, 1000) is None and coded(x[:5], np.vstack([x, np.full((1, 6), np.inf)]), None, 5, 10**6) is None
    for y in (x, np.repeat(rng.normal(size=(20, 6)), 30, axis=0)):  # the second has large groups of equals
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, vec array<double>")
        away = np.abs(y[:, None] - y[None]).sum(axis=2)
        np.fill_diagonal(away, np.inf)
        near = np.argsort(away, axis=1, kind="stable")[:, :3]
        assert {(r.q, r["rank"]): r.v for r in N.knn_join(df, df, 3, metric="manhattan").collect()} == {(i, j + 1): int(near[i, j]) for i in range(len(y)) for j in range(3)}
