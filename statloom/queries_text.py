"""Queries over texts and events: tokens, term weights, Bayes, streams, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.text import all_ngrams, tokens, without
from statloom.operators import terms
from statloom.plans.lineage import shared_dir
from statloom.registry import query, table
from statloom.sources import arff, delimited, libsvm
from statloom.streaming import carried, drift

_TOK = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text,'')),'[^\p{L}\p{Nd}]+',' ','g')),' '), lambda t: length(t)>=1)"
_TF = f"(SELECT doc_id, token, count(*) tf FROM (SELECT doc_id, unnest({_TOK}) token FROM documents) GROUP BY 1,2)"
_DF = f"(SELECT token, count(*) df, sum(tf) total FROM {_TF} GROUP BY 1)"
_N = "(SELECT count(*) n FROM documents)"


def _counts(spark: SparkSession, sf_dir: str, length: bool = False) -> DataFrame:
    return terms.term_counts(table(spark, sf_dir, "documents"), "doc_id", "text", unique=True, length=length)


@query(f"SELECT doc_id, len({_TOK}) n_tokens, list_distinct({_TOK}).len() n_distinct FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT * FROM {_TF}")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@query(f"SELECT token, df, total::BIGINT total FROM {_DF} WHERE df>=3")
def vocabulary_min_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.vocabulary(_counts(spark, sf_dir), 3)


@query(f"""WITH t AS (SELECT conv_id, turn, {_TOK} w FROM conversations), g AS (
 SELECT conv_id, turn, unnest(list_concat(w, list_concat(list_transform(range(1,greatest(len(w),1)), lambda i: array_to_string(w[i:i+1],' ')), list_transform(range(1,greatest(len(w)-1,1)), lambda i: array_to_string(w[i:i+2],' '))))) gram FROM t)
 SELECT gram, count(*) n FROM g GROUP BY 1""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(tokens(F.col("text")).alias("w"))
    return t.select(F.explode(all_ngrams(F.col("w"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_STOP = ["the", "of", "and", "to", "in", "a", "is", "that"]


@query("SELECT doc_id, len(list_filter(" + _TOK + ", lambda t: t NOT IN (" + ",".join(f"'{w}'" for w in _STOP) + "))) n FROM documents")
def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(without(tokens(F.col("text")), _STOP)).cast("long").alias("n"))


def _tfidf_sql(tf: str) -> str:
    return f"SELECT doc_id, token, round({tf}*ln(n::DOUBLE/df),9) weight FROM {_TF} JOIN {_DF} USING (token), {_N}"


@query(_tfidf_sql("tf"))
def tfidf_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tf_idf(_counts(spark, sf_dir), table(spark, sf_dir, "documents").count(), "document")


@query(_tfidf_sql("(1+ln(tf))"))
def tfidf_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tf_idf(_counts(spark, sf_dir), table(spark, sf_dir, "documents").count(), "log")


@query(_tfidf_sql("1"))
def tfidf_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.tf_idf(_counts(spark, sf_dir), table(spark, sf_dir, "documents").count(), "boolean")


@query(f"""WITH l AS (SELECT doc_id, sum(tf) len FROM {_TF} GROUP BY 1), m AS (SELECT avg(len) mean FROM l)
 SELECT doc_id, token, round(ln((n-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*len/mean)),9) weight FROM {_TF} JOIN {_DF} USING (token) JOIN l USING (doc_id), m, {_N}""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.bm25(_counts(spark, sf_dir, True), "doc_id", table(spark, sf_dir, "documents").count())


@query(f"""WITH c AS (SELECT quality, token, sum(tf)::DOUBLE n FROM {_TF} JOIN labels USING (doc_id) GROUP BY 1,2), v AS (SELECT count(DISTINCT token)::DOUBLE v FROM c),
 t AS (SELECT quality, sum(n) t FROM c GROUP BY 1) SELECT quality, token, round(ln((n+1)/(t+v)),9) log_likelihood FROM c JOIN t USING (quality), v""")
def multinomial_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed log likelihoods of tokens by class."""
    c = _counts(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("quality", "token").agg(F.sum("tf").cast("double").alias("n"))
    t = c.groupBy("quality").agg(F.sum("n").alias("t"))
    v = c.agg(F.countDistinct("token").cast("double").alias("v"))
    return c.join(F.broadcast(t), "quality").join(F.broadcast(v)).select("quality", "token", F.round(F.log((F.col("n") + 1) / (F.col("t") + F.col("v"))), 9).alias("log_likelihood"))


# Sources and sinks ---------------------------------------------------------------


def _fresh(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


_CUSTOMER = "SELECT c_custkey, c_nationkey, c_acctbal, lower(c_mktsegment) c_mktsegment FROM customer"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", F.lower("c_mktsegment").alias("c_mktsegment"))


@query(_CUSTOMER)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = _customers(spark, sf_dir), _fresh(spark)
    delimited.write(x, path)
    return delimited.read(spark, path, x.schema)


@query(_CUSTOMER)
def arff_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = _customers(spark, sf_dir), _fresh(spark)
    arff.write(x, path, "customer")
    return arff.read(spark, path).select(F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


@query("SELECT vec_id, \"label\"::DOUBLE AS \"label\", len(embedding) n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)),5) total FROM embeddings")
def libsvm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = table(spark, sf_dir, "embeddings"), _fresh(spark)
    libsvm.write(x.select(F.col("vec_id").cast("double").alias("target"), F.col("embedding").cast("array<double>").alias("v")), path, "target", "v")
    back = libsvm.read(spark, path, 64).select(F.col("target").cast("long").alias("vec_id"), "v")
    sums = F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b), 5)
    return back.join(x.select("vec_id", F.col("label").cast("double").alias("label")), "vec_id").select("vec_id", "label", F.size("v").cast("long").alias("n"), sums.alias("total"))


# Streams ------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS \"start\", count(*) n, round(sum(value),6) total FROM events GROUP BY 1,2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of events read as a stream, to the end of what is there."""
    return drift.tumbling(spark, f"{sf_dir}/events.parquet", "1 hour").withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 6)})


_DDM = """WITH RECURSIVE e AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) i, coalesce(value > 20, false) ok FROM events),
 r AS (SELECT event_type, 0::BIGINT i, 0::BIGINT n, 0::BIGINT bad, 1e300::DOUBLE lp, 1e300::DOUBLE ls, 'ok' state FROM (SELECT DISTINCT event_type FROM events)
 UNION ALL SELECT event_type, i, n, bad, lp, ls, CASE WHEN n < 30 THEN 'ok' WHEN p + s > lp + 3 * ls THEN 'drift' WHEN p + s > lp + 2 * ls THEN 'warning' ELSE 'ok' END FROM (
 SELECT *, CASE WHEN n >= 30 AND p + s < l0 + s0 THEN p ELSE l0 END lp, CASE WHEN n >= 30 AND p + s < l0 + s0 THEN s ELSE s0 END ls FROM (
 SELECT *, bad / n::DOUBLE p, sqrt(bad / n::DOUBLE * (1 - bad / n::DOUBLE) / n) s FROM (
 SELECT e.event_type, e.i, CASE WHEN state = 'drift' THEN 0 ELSE n END + 1 n, CASE WHEN state = 'drift' THEN 0 ELSE bad END + (NOT ok)::INT bad, CASE WHEN state = 'drift' THEN 1e300 ELSE lp END l0, CASE WHEN state = 'drift' THEN 1e300 ELSE ls END s0
 FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1))))
 SELECT event_type, i AS "at", state FROM r WHERE state <> 'ok'"""


@query(_DDM)
def ddm_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and drifts of each kind's ordered events; the detector starts anew after a drift."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", (F.col("value") > 20).alias("ok"))
    return drift.ddm(e, "event_type", ["ts", "event_id"], "ok")


@query(_DDM)
def stream_ddm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream whose state is kept a kind."""
    e = drift.read_stream(spark, f"{sf_dir}/events.parquet").select("event_type", "event_id", "ts", (F.col("value") > 20).alias("ok"))
    return carried.ddm(e, "event_type", ["ts", "event_id"], "ok")


@query()
def adwin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the mean of values drifts that rise by 60 for every other 700 events."""
    raised = F.col("value") + F.when(F.floor(F.col("event_id") / 700) % 2 == 1, 60.0).otherwise(0.0)
    e = table(spark, sf_dir, "events").select("event_type", "event_id", raised.alias("value"))
    return drift.adwin(e, "event_type", ["event_id"], "value")


@query()
def stream_adwin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream."""
    raised = F.col("value") + F.when(F.floor(F.col("event_id") / 700) % 2 == 1, 60.0).otherwise(0.0)
    e = drift.read_stream(spark, f"{sf_dir}/events.parquet").select("event_type", "event_id", raised.alias("value"))
    return carried.adwin(e, "event_type", ["event_id"], "value")
