"""Queries over indexes, hierarchies and dual machines, which hold every row of their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.models import dual
from statloom.models.online import rbf
from statloom.operators import clustering, embedding, hierarchy
from statloom.operators.projections import ProjectionIndex
from statloom.plans.lineage import cut
from statloom.queries_vectors import _E, _vectors
from statloom.registry import query


@query()
def projection_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every twentieth vector, by random projections."""
    x = _vectors(spark, sf_dir).select("id", "vec")
    return ProjectionIndex(x).nearest(x.where("id % 20 = 0"), 5).withColumn("distance", F.round("distance", 6))


@query()
def hdbscan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable branches of the hierarchy of mutual reachability over all vectors."""
    return clustering.hdbscan(_vectors(spark, sf_dir).select("id", "vec"), least=4, smallest=5, k=12)


def _linked(spark: SparkSession, sf_dir: str, linkage: str) -> DataFrame:
    return clustering.hierarchical(_vectors(spark, sf_dir).select("id", "vec"), 10, linkage)


@query()
def ward_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors by Ward's linkage."""
    return _linked(spark, sf_dir, "ward")


@query()
def average_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors by average linkage."""
    return _linked(spark, sf_dir, "average")


@query()
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten clusters of all vectors by complete linkage."""
    return _linked(spark, sf_dir, "complete")


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.id q, b.id v FROM {_E} a JOIN {_E} b ON list_distance(a.v,b.v) <= 1.0), r AS (SELECT id q, id v FROM {_E} UNION SELECT r.q, p.v FROM r JOIN p ON p.q = r.v)
 SELECT q id, min(v) "cluster" FROM r GROUP BY 1""")
def single_linkage_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of single linkage cut at height one: what merges no higher."""
    rows = cut(_vectors(spark, sf_dir).select("id", "vec"))
    return hierarchy.single_below(rows, 1.0)


@query()
def dual_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's side and decision value by the kernel machine of the lowest third of labels against the others."""
    x = _vectors(spark, sf_dir)
    third = x.agg(F.percentile("label", F.lit(1 / 3))).first()[0] or 0
    rows = x.select("id", F.col("vec").alias("features"), (F.col("label") <= third).cast("double").alias("label"))
    model = dual.DualMachine(rbf(1.0), c=1.0).fit(rows)
    return model.decide(rows).select("id", "label", F.round("decision", 2).alias("decision"))


@query()
def optics_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's place in the reachability ordering, with the steep valleys."""
    got = clustering.optics(_vectors(spark, sf_dir).select("id", "vec"), least=4, k=12, xi=0.05)
    return got.withColumns({"core": F.round("core", 6), "reach": F.round("reach", 6)})


@query()
def isomap_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's place in the plane by path lengths among neighbours; signs of axes are as the largest entry is positive."""
    got = cut(embedding.isomap(_vectors(spark, sf_dir).select("id", "vec"), 2, 10, landmarks=64))
    flip = got.agg(*[F.max_by(F.signum(F.col("x")[i]), F.abs(F.col("x")[i])).alias(f"s{i}") for i in range(2)])
    return got.join(F.broadcast(flip)).select("id", *[F.round(F.col("x")[i] * F.col(f"s{i}"), 4).alias(f"x{i}") for i in range(2)])  # one row
