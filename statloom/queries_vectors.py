"""Queries over vectors: algebra, distances, kernels, neighbours, clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import vec as V
from statloom.operators import neighbors
from statloom.plans.lineage import cut, small
from statloom.registry import query, table

_E = "(SELECT vec_id id, list_transform(embedding, lambda x: x::DOUBLE) v, \"label\" FROM embeddings)"
_CENT = f"(SELECT \"label\" c, i, avg(x) x FROM (SELECT \"label\", unnest(v) x, generate_subscripts(v,1) i FROM {_E}) GROUP BY 1,2)"
_CV = f"(SELECT c, list(x ORDER BY i) m FROM {_CENT} GROUP BY 1)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _centroids(x: DataFrame) -> DataFrame:
    """``c, m``: the mean vector of each label (a row a label)."""
    one = x.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    sorted_ = F.array_sort(F.collect_list(F.struct("i", "x")))
    return one.groupBy(F.col("label").alias("c")).agg(F.transform(sorted_, lambda s: s["x"]).alias("m"))


@query(f"""SELECT id, len(v) n, len(list_filter(v, lambda x: x<>0)) nnz, round(list_sum(v),6) total, round(list_avg(v),6) mean, round(list_var_pop(v),6) variance, round(list_min(v),6) "min", round(list_max(v),6) "max",
 round(list_median(v),6) median, round(sqrt(list_inner_product(v,v)),6) norm2, round(list_sum(list_transform(v, lambda x: abs(x))),6) norm1, round(list_sum(list_transform(v, lambda x: x*x*x)),6) cubes FROM {_E}""")
def vec_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _vectors(spark, sf_dir).select(
        "id", F.size(v).cast("long").alias("n"), V.nnz(v).cast("long").alias("nnz"), r(V.total(v), "total"), r(V.mean(v), "mean"), r(V.variance(v), "variance"),
        r(F.array_min(v), "min"), r(F.array_max(v), "max"), r(V.median(v), "median"), r(V.p_norm(v, 2.0), "norm2"), r(V.p_norm(v, 1.0), "norm1"),
        r(V.total(V.multiply(V.multiply(v, v), v)), "cubes"),
    )


@query(f"SELECT c, i::INT-1 i, round(x,6) x FROM {_CENT}")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(_vectors(spark, sf_dir)).select("c", F.posexplode("m").alias("i", "x")).withColumn("x", F.round("x", 6))


def _to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    return x.crossJoin(small(cut(_centroids(x))))  # a row a label


_PAIR = f"{_E}, {_CV}"


@query(f"""SELECT id, c, round(list_distance(v,m),6) euclidean, round(pow(list_distance(v,m),2),6) squared, round(list_sum(list_transform(list_zip(v,m), lambda p: abs(p[1]-p[2]))),6) manhattan,
 round(list_max(list_transform(list_zip(v,m), lambda p: abs(p[1]-p[2]))),6) chebyshev, round(pow(list_sum(list_transform(list_zip(v,m), lambda p: pow(abs(p[1]-p[2]),3))),1.0/3),6) minkowski3,
 round(1-list_cosine_similarity(v,m),6) cosine, round(list_inner_product(v,m),6) dot,
 round(1-list_sum(list_transform(list_zip(v,m), lambda p: least(abs(p[1]),abs(p[2]))))/list_sum(list_transform(list_zip(v,m), lambda p: greatest(abs(p[1]),abs(p[2])))),6) jaccard FROM {_PAIR}""")
def vec_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("vec"), F.col("m")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _to_centroids(spark, sf_dir).select(
        "id", "c", r(V.euclidean(a, b), "euclidean"), r(V.squared_euclidean(a, b), "squared"), r(V.manhattan(a, b), "manhattan"), r(V.chebyshev(a, b), "chebyshev"),
        r(V.minkowski(a, b, 3.0), "minkowski3"), r(V.cosine_distance(a, b), "cosine"), r(V.dot(a, b), "dot"), r(V.weighted_jaccard_distance(a, b), "jaccard"),
    )


@query(f"""SELECT id, c, round(exp(-pow(list_distance(v,m),2)/2),6) rbf, round(pow(list_inner_product(v,m)+1,2),6) polynomial, round(tanh(list_inner_product(v,m)),6) sigmoid,
 round(1-pow(list_distance(v,m),2)/(pow(list_distance(v,m),2)+1),6) rational_quadratic FROM {_PAIR}""")
def vec_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("vec"), F.col("m")
    r = lambda c, n: F.round(c, 6).alias(n)
    return _to_centroids(spark, sf_dir).select(
        "id", "c", r(V.rbf_kernel(a, b), "rbf"), r(V.polynomial_kernel(a, b), "polynomial"), r(V.sigmoid_kernel(a, b), "sigmoid"), r(V.rational_quadratic_kernel(a, b), "rational_quadratic"),
    )


@query(f"SELECT id, arg_min(c, (round(list_distance(v,m),9), c)) cluster, round(min(list_distance(v,m)),6) distance FROM {_PAIR} GROUP BY 1")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Lloyd step from the label centroids, which is Rocchio's rule too."""
    d = V.euclidean(F.col("vec"), F.col("m"))
    x = _to_centroids(spark, sf_dir).select("id", "c", d.alias("d"))
    return x.groupBy("id").agg(F.min_by("c", F.struct(F.round("d", 9), F.col("c"))).alias("cluster"), F.round(F.min("d"), 6).alias("distance"))


@query(f"""WITH s AS (SELECT "label" c, avg(list_distance(v,m)) s FROM {_E} JOIN {_CV} ON c="label" GROUP BY 1),
 p AS (SELECT a.c, max((x.s+y.s)/list_distance(a.m,b.m)) r FROM {_CV} a JOIN {_CV} b ON a.c<>b.c JOIN s x ON x.c=a.c JOIN s y ON y.c=b.c GROUP BY 1) SELECT round(avg(r),6) davies_bouldin FROM p""")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    m = small(cut(_centroids(x)))
    s = x.join(m, F.col("label") == F.col("c")).groupBy("c", "m").agg(F.avg(V.euclidean(F.col("vec"), F.col("m"))).alias("s"))
    b = s.select(F.col("c").alias("c2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    worst = s.join(b, F.col("c") != F.col("c2")).groupBy("c").agg(F.max((F.col("s") + F.col("s2")) / V.euclidean(F.col("m"), F.col("m2"))).alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


_KNN = f"(SELECT q, v2 v, d, row_number() OVER (PARTITION BY q ORDER BY d, v2) r FROM (SELECT a.id q, b.id v2, list_distance(a.v,b.v) d FROM {_E} a JOIN {_E} b ON a.id<>b.id))"


@query(f"SELECT q, r::INT \"rank\", v, round(d,6) distance FROM {_KNN} WHERE r<=5")
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir).select("id", "vec")
    return neighbors.knn_join(x, x, 5).withColumn("distance", F.round("distance", 6))


@query(f"SELECT a.id q, b.id v, round(list_distance(a.v,b.v),6) distance FROM {_E} a JOIN {_E} b ON list_distance(a.v,b.v)<=1.15")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir).select("id", "vec")
    return neighbors.range_join(x, x, 1.15).withColumn("distance", F.round("distance", 6))


@query(f"""WITH n AS (SELECT k.q, e."label" l, count(*) c FROM {_KNN} k JOIN {_E} e ON e.id=k.v WHERE k.r<=7 GROUP BY 1,2) SELECT q id, arg_max(l, (c, -l)) predicted FROM n GROUP BY 1""")
def knn_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    near = neighbors.knn_join(x.select("id", "vec"), x.select("id", "vec"), 7)
    votes = near.join(x.select(F.col("id").alias("v"), "label"), "v").groupBy("q", "label").agg(F.count("*").alias("c"))
    return votes.groupBy(F.col("q").alias("id")).agg(F.max_by("label", F.struct("c", -F.col("label"))).alias("predicted"))


@query(f"""WITH k AS (SELECT * FROM {_KNN} WHERE r<=5), z AS (SELECT q, max(d) z FROM k GROUP BY 1), l AS (SELECT k.q, 1/avg(greatest(z.z,k.d)) l FROM k JOIN z ON z.q=k.v GROUP BY 1)
 SELECT k.q id, round(avg(b.l)/any_value(a.l),6) lof FROM k JOIN l a ON a.q=k.q JOIN l b ON b.q=k.v GROUP BY 1""")
def local_outlier_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.local_outlier_factor(_vectors(spark, sf_dir).select("id", "vec"), 5).withColumn("lof", F.round("lof", 6))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.id q, b.id v FROM {_E} a JOIN {_E} b ON list_distance(a.v,b.v)<=1.1), core AS MATERIALIZED (SELECT q FROM p GROUP BY 1 HAVING count(*)>=3),
 e AS MATERIALIZED (SELECT * FROM p WHERE q IN (FROM core) AND v IN (FROM core)), r AS (SELECT q, q v FROM core UNION SELECT r.q, e.v FROM r JOIN e ON e.q=r.v),
 c AS (SELECT q, min(v) c FROM r GROUP BY 1), b AS (SELECT p.q, arg_min(c.c, p.v) c FROM p JOIN c ON c.q=p.v GROUP BY 1)
 SELECT id, coalesce(c.c, b.c, -1)::BIGINT "cluster" FROM {_E} LEFT JOIN c ON c.q=id LEFT JOIN b ON b.q=id""")
def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.dbscan(_vectors(spark, sf_dir).select("id", "vec"), 1.1, 3)
