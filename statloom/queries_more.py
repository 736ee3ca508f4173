"""Further queries: densities, softmax, cluster spread, hashing, stemming, synthetic rows, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import vec as V
from statloom.functions.stem import porter_stem
from statloom.functions.text import tokens
from statloom.operators import neighbors, terms
from statloom.queries_vectors import _CV, _E, _KNN, _centroids, _vectors
from statloom.plans.lineage import cut, small
from statloom.registry import query, table
from statloom.streaming import drift


@query("""SELECT g::INT g, round(avg(exp(-pow((value-g*3)/4,2)/2)/(4*sqrt(2*pi()))),9) density FROM events, range(0,50) r(g) GROUP BY 1""")
def kde_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian kernel density of event values at fifty points."""
    grid = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("g")
    x = table(spark, sf_dir, "events").where("value is not null").select("value", grid)
    z = (F.col("value") - F.col("g") * 3) / 4
    return x.groupBy("g").agg(F.round(F.avg(F.exp(-z * z / 2) / (4 * F.sqrt(F.lit(2.0) * F.pi()))), 9).alias("density"))


@query(f"""SELECT id, round(m+ln(list_sum(list_transform(v, lambda x: exp(x-m)))),6) log_sum_exp, round(1/list_sum(list_transform(v, lambda x: exp(x-m))),6) top_softmax FROM (SELECT id, v, list_max(v) m FROM {_E})""")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir).select("id", "vec", F.array_max("vec").alias("m"))
    total = V.total(F.transform("vec", lambda v: F.exp(v - F.col("m"))))
    return x.select("id", F.round(F.col("m") + F.log(total), 6).alias("log_sum_exp"), F.round(1 / total, 6).alias("top_softmax"))


@query(f"""SELECT c, count(*) n, round(avg(list_distance(v,m)),6) mean_distance, round(max(list_distance(v,m)),6) max_distance, round(sum(pow(list_distance(v,m),2)),6) sum_squares FROM {_E} JOIN {_CV} ON c="label" GROUP BY 1""")
def intra_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _vectors(spark, sf_dir)
    d = V.euclidean(F.col("vec"), F.col("m"))
    j = x.join(small(cut(_centroids(x))), F.col("label") == F.col("c")).select("c", d.alias("d"))
    return j.groupBy("c").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean_distance"), F.round(F.max("d"), 6).alias("max_distance"), F.round(F.sum(F.col("d") * F.col("d")), 6).alias("sum_squares"))


@query(f"""WITH i AS (SELECT max(list_distance(v,m)) i FROM {_E} JOIN {_CV} ON c="label"), o AS (SELECT min(list_distance(a.m,b.m)) o FROM {_CV} a JOIN {_CV} b ON a.c<b.c) SELECT round(o/i,6) dunn, round(i/(o+i),6) score FROM i, o""")
def dunn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least distance of centroids over largest distance to a centroid, and its bounded form."""
    x = _vectors(spark, sf_dir)
    m = _centroids(x)
    inner = x.join(m, F.col("label") == F.col("c")).agg(F.max(V.euclidean(F.col("vec"), F.col("m"))).alias("i"))
    other = m.select(F.col("c").alias("c2"), F.col("m").alias("m2"))
    outer = m.join(other, F.col("c") < F.col("c2")).agg(F.min(V.euclidean(F.col("m"), F.col("m2"))).alias("o"))
    return inner.join(outer).select(F.round(F.col("o") / F.col("i"), 6).alias("dunn"), F.round(F.col("i") / (F.col("o") + F.col("i")), 6).alias("score"))


_TOKENS = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text,'')),'[^\p{L}\p{Nd}]+',' ','g')),' '), lambda t: length(t)>=1)"


@query(f"SELECT doc_id, ('0x' || left(md5(token), 2))::INT bucket, count(*) n FROM (SELECT doc_id, unnest({_TOKENS}) token FROM documents) GROUP BY 1, 2")
def feature_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts in 256 hashed columns; colliding tokens add up."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    bucket = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 2), 16, 10).cast("int")
    return t.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query()
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of stems; each distinct token is stemmed once."""
    words = terms.totals(table(spark, sf_dir, "documents"), "text")
    return words.select(porter_stem(F.col("token")).alias("stem"), "total").groupBy("stem").agg(F.sum("total").alias("total"))


@query(f"""SELECT a.id, round(list_sum(list_transform(list_zip(a.v,b.v), lambda p: p[1]+0.25*(p[2]-p[1]))),6) total FROM {_KNN} k JOIN {_E} a ON a.id=k.q JOIN {_E} b ON b.id=k.v WHERE k.r=1""")
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic vector between each vector and its nearest neighbour, a quarter of the way; its sum is told."""
    x = _vectors(spark, sf_dir).select("id", "vec")
    near = neighbors.knn_join(x, x, 1)
    made = near.join(x.select(F.col("id").alias("q"), F.col("vec").alias("a")), "q").join(x.select(F.col("id").alias("v"), F.col("vec").alias("b")), "v")
    return made.select(F.col("q").alias("id"), F.round(V.total(F.zip_with("a", "b", lambda p, r: p + 0.25 * (r - p))), 6).alias("total"))


_EMA = """WITH RECURSIVE e AS (SELECT user_id, value x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, row_number() OVER (PARTITION BY user_id, value IS NULL ORDER BY ts, event_id) j FROM events),
 v AS (SELECT * FROM e WHERE x IS NOT NULL), r AS (SELECT user_id, i, j, x m, 0.0::DOUBLE s FROM v WHERE j = 1
 UNION ALL SELECT v.user_id, v.i, v.j, m + 0.1 * (x - m), 0.9 * (s + 0.1 * (x - m) * (x - m)) FROM r JOIN v ON v.user_id = r.user_id AND v.j = r.j + 1)
 SELECT user_id, i AS "at", round(m,6) mean, round(s,6) variance FROM r"""


@query(_EMA)
def exponential_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return drift.ema(e, "user_id", ["ts", "event_id"], "value").select("user_id", "at", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query(_EMA)
def stream_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, whose state a user is stored with each batch."""
    from statloom.streaming import carried

    e = drift.read_stream(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    return carried.ema(e, "user_id", ["ts", "event_id"], "value").select("user_id", "at", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))
