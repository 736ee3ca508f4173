"""Queries over tables of numbers and categories: statistics, splits, metrics, transforms, scalars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.functions import scalar as S
from statloom.operators import dataset, metrics, stats, transforms
from statloom.registry import query, table

_MOMENTS = """
WITH s AS (SELECT {by}, sum({w}) n, sum({w}*x) s1, sum({w}*x*x) s2, sum({w}*x*x*x) s3, sum({w}*x*x*x*x) s4, min(x) mn, max(x) mx
 FROM (SELECT *, l_extendedprice/1000 x FROM lineitem) GROUP BY {by}),
 m AS (SELECT *, s1/n mu, s2/n-(s1/n)*(s1/n) m2 FROM s)
SELECT {by}, n::DOUBLE n, round(mu,6) mean, round(m2,6) variance,
 round((s3/n-3*mu*s2/n+2*mu*mu*mu)/pow(m2,1.5),6) skewness,
 round((s4/n-4*mu*s3/n+6*mu*mu*s2/n-3*mu*mu*mu*mu)/(m2*m2)-3,6) kurtosis, mn "min", mx "max" FROM m"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


@query(_MOMENTS.format(by="l_returnflag, l_linestatus", w="1.0"))
def col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 1000).alias("x"))
    return stats.moments(df, "x", ["l_returnflag", "l_linestatus"])


@query(_MOMENTS.format(by="l_returnflag, l_linestatus", w="l_quantity"))
def col_stats_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _lines(spark, sf_dir).select("l_returnflag", "l_linestatus", "l_quantity", (F.col("l_extendedprice") / 1000).alias("x"))
    return stats.moments(df, "x", ["l_returnflag", "l_linestatus"], weight="l_quantity")


_COLS = ("l_quantity", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, round(covar_samp({a},{b}),6) covariance, round(corr({a},{b}),6) correlation FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:]))
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.covariance_matrix(_lines(spark, sf_dir).select(*_COLS), _COLS)


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice,l_quantity),6) slope, round(regr_intercept(l_extendedprice,l_quantity),4) intercept, round(regr_r2(l_extendedprice,l_quantity),6) r2 FROM lineitem GROUP BY 1")
def simple_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.simple_regression(_lines(spark, sf_dir), "l_extendedprice", "l_quantity", ["l_returnflag"]).withColumn("intercept", F.round("intercept", 4))


@query("""WITH e AS (SELECT value v, sum((event_type='click')::INT) a, sum((event_type='view')::INT) b FROM events WHERE event_type IN ('click','view') AND value IS NOT NULL GROUP BY 1),
 r AS (SELECT sum(a) OVER (ORDER BY v) ca, sum(b) OVER (ORDER BY v) cb, sum(a) OVER () n1, sum(b) OVER () n2 FROM e)
 SELECT n1::BIGINT n1, n2::BIGINT n2, round(max(abs(ca/n1-cb/n2)),9) d FROM r GROUP BY 1,2""")
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ks_two_sample(table(spark, sf_dir, "events"), "value", "event_type", "click", "view")


@query("SELECT event_type, count(value) n, round((avg(value)-50)*sqrt(count(value))/stddev_pop(value),6) t, round((avg(value)-50)*sqrt(count(value))/10,6) z FROM events GROUP BY 1")
def t_and_z_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.one_sample_tests(table(spark, sf_dir, "events"), "value", ["event_type"], 50.0, 10.0)


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice v, sum(l_quantity) w FROM lineitem GROUP BY 1,2),
 r AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) c, sum(w) OVER (PARTITION BY l_returnflag) t FROM s)
 SELECT l_returnflag, min(v) median FROM r WHERE 2*c>=t GROUP BY 1""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_median(_lines(spark, sf_dir), "l_extendedprice", "l_quantity", ["l_returnflag"])


# Dataset operators ---------------------------------------------------------


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir)
    return x.select("l_orderkey", "l_linenumber", F.expr("nullif(l_discount, 0.05)").alias("l_discount"), F.expr("nullif(l_returnflag, 'N')").alias("l_returnflag"))


_GAPS = "(SELECT l_orderkey, l_linenumber, nullif(l_discount,0.05) l_discount, nullif(l_returnflag,'N') l_returnflag FROM lineitem)"


@query(f"SELECT * FROM {_GAPS} WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
def missing_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.drop_missing(_gaps(spark, sf_dir), ["l_discount", "l_returnflag"])


@query(f"SELECT 'l_discount' AS \"column\", count(*)-count(l_discount) missing FROM {_GAPS} UNION ALL SELECT 'l_returnflag', count(*)-count(l_returnflag) FROM {_GAPS}")
def missing_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.count_missing(_gaps(spark, sf_dir), ["l_discount", "l_returnflag"])


@query("SELECT c_mktsegment, count(*) n, round(count(*)/sum(count(*)) OVER (),9) prior FROM customer GROUP BY 1")
def class_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.priors(table(spark, sf_dir, "customer"), "c_mktsegment")


_KEY = "md5('1/' || o_orderkey)"
_AT = f"row_number() OVER (ORDER BY {_KEY}, o_orderkey)-1"


@query(f"SELECT o_orderkey, (CASE WHEN a < round(0.6*n) THEN 0 WHEN a < round(0.9*n) THEN 1 ELSE -1 END)::INT split FROM (SELECT o_orderkey, {_AT} a, count(*) OVER () n FROM orders)")
def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", [0.6, 0.3])


@query(f"SELECT o_orderkey, ({_AT})::INT % 5 fold FROM orders")
def cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.folds(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5)


_STRAT = f"SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_KEY}, o_orderkey)-1) % 5)::INT fold FROM orders"


@query(_STRAT)
def strat_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, by=["o_orderstatus"])


@query(f"SELECT o_orderstatus, count(*) n, min(o_orderkey) first FROM ({_STRAT}) WHERE fold<>2 GROUP BY 1")
def all_but_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.all_but(strat_folds(spark, sf_dir), 2).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment='BUILDING')")
def row_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(keys, "o_custkey", "left_semi")


# Metrics --------------------------------------------------------------------

_PRED = "(SELECT l.quality y, CASE WHEN d.n_chars>=800 THEN 1 ELSE 0 END p, d.n_chars/(d.n_chars+800.0) s FROM labels l JOIN documents d USING (doc_id))"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    x = table(spark, sf_dir, "labels").join(d, "doc_id")
    return x.select(F.col("quality").alias("y"), F.when(F.col("n_chars") >= 800, 1).otherwise(0).alias("p"), (F.col("n_chars") / (F.col("n_chars") + 800.0)).alias("s"))


@query(f"SELECT y \"label\", p predicted, count(*) n FROM {_PRED} GROUP BY 1,2")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir), "y", "p")


_C = f"(SELECT count(*) FILTER (y=0 AND p=0)::DOUBLE tp, count(*) FILTER (y=1 AND p=0)::DOUBLE fp, count(*) FILTER (y=0 AND p=1)::DOUBLE fn, count(*) FILTER (y=1 AND p=1)::DOUBLE tn, count(*)::DOUBLE t FROM {_PRED})"
_SCORES = {
    "accuracy": "(tp+tn)/t", "balanced_accuracy": "(tp/(tp+fn)+tn/(tn+fp))/2", "precision": "tp/(tp+fp)", "recall": "tp/(tp+fn)",
    "f1": "2*tp/(2*tp+fp+fn)", "fbeta": "5*tp/(5*tp+4*fn+fp)", "mcc": "(tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))",
    "kappa": "((tp+tn)/t-((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(t*t))/(1-((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/(t*t))",
}


@query(" UNION ALL ".join(f"SELECT '{k}' metric, round({v},9) AS \"value\" FROM {_C}" for k, v in _SCORES.items()))
def binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_scores(_predictions(spark, sf_dir), "y", "p")


@query(f"SELECT round(avg(CASE WHEN y=1 THEN -ln(greatest(s,1e-15)) ELSE -ln(1-least(greatest(s,1e-15),1-1e-15)) END),9) log_loss FROM {_PRED}")
def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.log_loss(_predictions(spark, sf_dir), "y", "s")


@query(f"""WITH g AS (SELECT s, sum(y)::DOUBLE p, sum(1-y)::DOUBLE q FROM {_PRED} GROUP BY 1), r AS (SELECT *, sum(q) OVER (ORDER BY s) c FROM g)
 SELECT round(sum(p*(c-q/2))/(sum(p)*sum(q)),9) auc FROM r""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(_predictions(spark, sf_dir), "y", "s")


_REG = "(SELECT l_extendedprice/1000 y, l_quantity*1.5 p FROM lineitem)"
_RSUM = f"(SELECT avg(abs(y-p)) a, avg((y-p)*(y-p)) b, sum(abs(y-p))/sum(abs(y-m)) c, sum((y-p)*(y-p))/sum((y-m)*(y-m)) d FROM {_REG}, (SELECT avg(y) m FROM {_REG}))"


@query(" UNION ALL ".join(f"SELECT '{k}' metric, round({v},6) AS \"value\" FROM {_RSUM}" for k, v in {"mae": "a", "mse": "b", "rmse": "sqrt(b)", "rae": "c", "rse": "d", "r2": "1-d"}.items()))
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _lines(spark, sf_dir).select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    return metrics.regression_scores(x, "y", "p")


_CELL = """(WITH c AS (SELECT c_mktsegment l, c_nationkey k, count(*)::DOUBLE n FROM customer GROUP BY 1,2)
 SELECT n, sum(n) OVER (PARTITION BY l) a, sum(n) OVER (PARTITION BY k) b, sum(n) OVER () t FROM c)"""
_AGREE = f"(SELECT sum(n*(n-1)/2) i, sum(n/a*a*(a-1)/2) x, sum(n/b*b*(b-1)/2) y, first(t)*(first(t)-1)/2 pt, sum(n/t*ln(n*t/(a*b))) mi, -sum(n/t*ln(a/t)) hl, -sum(n/t*ln(b/t)) hc FROM {_CELL})"


@query(" UNION ALL ".join(f"SELECT '{k}' metric, round({v},9) AS \"value\" FROM {_AGREE}" for k, v in {
    "ari": "(i-x*y/pt)/((x+y)/2-x*y/pt)", "nmi": "2*mi/(hl+hc)", "homogeneity": "mi/hl", "completeness": "mi/hc", "v_measure": "2*(mi/hl)*(mi/hc)/(mi/hl+mi/hc)"}.items()))
def cluster_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.cluster_agreement(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


# Transforms -----------------------------------------------------------------

_T = ("l_quantity", "l_discount")


def _t_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", *_T)


def _over(expr: str) -> str:
    one = ", ".join(f"round({expr.replace('X', c)},6) {c}" for c in _T)
    agg = ", ".join(f"avg({c}) m_{c}, var_pop({c}) v_{c}, min({c}) lo_{c}, max({c}) hi_{c}" for c in _T)
    return f"SELECT l_orderkey, l_linenumber, {one} FROM lineitem, (SELECT {agg} FROM lineitem)"


@query(_over("(X-m_X)/sqrt(v_X+1e-10)"))
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.standardize(_t_input(spark, sf_dir), _T)


@query(_over("X-m_X"))
def zero_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.zero_mean(_t_input(spark, sf_dir), _T)


@query(_over("X/sqrt(v_X)"))
def unit_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.unit_variance(_t_input(spark, sf_dir), _T)


@query(_over("(X-lo_X)/(hi_X-lo_X)"))
def linear_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.linear_scale(_t_input(spark, sf_dir), _T)


@query("SELECT l_orderkey, l_linenumber, least(9,floor((l_quantity-lo)/((hi-lo)/10)))::INT l_quantity FROM lineitem, (SELECT min(l_quantity) lo, max(l_quantity) hi FROM lineitem)")
def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.histogram_bins(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 10)


@query("SELECT l_orderkey, l_linenumber, (l_returnflag='A')::INT l_returnflag_A, (l_returnflag='N')::INT l_returnflag_N, (l_returnflag='R')::INT l_returnflag_R FROM lineitem")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.one_hot(_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", ["A", "N", "R"])


@query(f"""SELECT l_orderkey, l_linenumber, round(coalesce(l_discount,m),9) l_discount, coalesce(l_returnflag,f) l_returnflag FROM {_GAPS}, (SELECT avg(l_discount) m FROM {_GAPS}),
 (SELECT l_returnflag f FROM {_GAPS} WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def imputer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.impute(_gaps(spark, sf_dir), mean=["l_discount"], mode=["l_returnflag"])
    return out.withColumn("l_discount", F.round("l_discount", 9))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_quantity*l_quantity l_quantity_l_quantity, round(l_quantity*l_discount,9) l_quantity_l_discount, round(l_discount*l_discount,9) l_discount_l_discount FROM lineitem")
def polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.polynomial(_t_input(spark, sf_dir), _T)
    return out.withColumns({c: F.round(c, 9) for c in ("l_quantity_l_discount", "l_discount_l_discount")})


@query("""WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE n FROM lineitem GROUP BY 1,2), m AS (SELECT *, sum(n) OVER () t, sum(n) OVER (PARTITION BY a) x, sum(n) OVER (PARTITION BY b) y FROM c)
 SELECT 'l_linestatus' feature, round(sum(n/t*ln(n*t/(x*y))),9) mutual_information FROM m""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.mutual_information(_lines(spark, sf_dir), "l_returnflag", ["l_linestatus"])


@query("""WITH v AS (SELECT l_quantity x, sum((l_returnflag='A')::INT)::DOUBLE a, sum((l_returnflag='N')::INT)::DOUBLE b, sum((l_returnflag='R')::INT)::DOUBLE c FROM lineitem GROUP BY 1),
 r AS (SELECT x, sum(a) OVER w a, sum(b) OVER w b, sum(c) OVER w c, sum(a) OVER () ta, sum(b) OVER () tb, sum(c) OVER () tc FROM v WINDOW w AS (ORDER BY x)),
 g AS (SELECT *, a+b+c n, ta+tb+tc t FROM r)
 SELECT x threshold, round((1-(ta*ta+tb*tb+tc*tc)/(t*t))-(n/t)*(1-(a*a+b*b+c*c)/(n*n))-((t-n)/t)*(1-((ta-a)*(ta-a)+(tb-b)*(tb-b)+(tc-c)*(tc-c))/((t-n)*(t-n))),9) gain FROM g WHERE n<t""")
def stump_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.gini_gains(_lines(spark, sf_dir), "l_quantity", "l_returnflag", ["A", "N", "R"])


# Scalar families -----------------------------------------------------------

_FAMILIES = {
    "exponential": S.exponential(0.05), "laplace": S.laplace(40.0, 12.0), "logistic": S.logistic(40.0, 9.0), "pareto": S.pareto(2.0, 1.5),
    "rayleigh": S.rayleigh(30.0), "weibull": S.weibull(1.5, 40.0), "uniform": S.uniform(10.0, 80.0), "cauchy": S.cauchy(40.0, 10.0), "log_uniform": S.log_uniform(1.0, 120.0),
}
_FAMILY_SQL = {
    "exponential": ("CASE WHEN x>=0 THEN 0.05*exp(-0.05*x) ELSE 0 END", "CASE WHEN x>=0 THEN 1-exp(-0.05*x) ELSE 0 END"),
    "laplace": ("exp(-abs(x-40)/12)/24", "CASE WHEN x<40 THEN exp((x-40)/12)/2 ELSE 1-exp(-(x-40)/12)/2 END"),
    "logistic": ("exp(-(x-40)/9)/(9*pow(1+exp(-(x-40)/9),2))", "1/(1+exp(-(x-40)/9))"),
    "pareto": ("CASE WHEN x>=2 THEN 1.5*pow(2,1.5)/pow(x,2.5) ELSE 0 END", "CASE WHEN x>=2 THEN 1-pow(2/x,1.5) ELSE 0 END"),
    "rayleigh": ("CASE WHEN x>=0 THEN x/900*exp(-x*x/1800) ELSE 0 END", "CASE WHEN x>=0 THEN 1-exp(-x*x/1800) ELSE 0 END"),
    "weibull": ("CASE WHEN x>=0 THEN 1.5/40*pow(x/40,0.5)*exp(-pow(x/40,1.5)) ELSE 0 END", "CASE WHEN x>=0 THEN 1-exp(-pow(x/40,1.5)) ELSE 0 END"),
    "uniform": ("CASE WHEN x BETWEEN 10 AND 80 THEN 1/70.0 ELSE 0 END", "least(greatest((x-10)/70,0),1)"),
    "cauchy": ("1/(pi()*10*(1+pow((x-40)/10,2)))", "atan((x-40)/10)/pi()+0.5"),
    "log_uniform": ("CASE WHEN x BETWEEN 1 AND 120 THEN 1/(x*ln(120)) ELSE 0 END", "CASE WHEN x<1 THEN 0 WHEN x>120 THEN 1 ELSE ln(x)/ln(120) END"),
}


@query("SELECT event_id, " + ", ".join(f"round({p},9) {k}_pdf, round({c},9) {k}_cdf" for k, (p, c) in _FAMILY_SQL.items()) + " FROM (SELECT event_id, value+1 x FROM events)")
def distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") + 1
    out = []
    for k, (pdf, cdf) in _FAMILIES.items():
        out += [F.round(pdf(x), 9).alias(f"{k}_pdf"), F.round(cdf(x), 9).alias(f"{k}_cdf")]
    return table(spark, sf_dir, "events").select("event_id", *out)


@query(f"""SELECT event_id, round(exp(-(x-40)*(x-40)/200)/(10*sqrt({2 * math.pi!r})),9) normal_pdf, round(sqrt({2 / math.pi!r})*x*x*exp(-x*x/1800)/27000,9) maxwell_boltzmann_pdf,
 round(exp(-pow(ln(x)-3,2)/2)/(x*sqrt({2 * math.pi!r})),9) log_normal_pdf, round(6*pow(u,1)*pow(1-pow(u,2),2),9) kumaraswamy_pdf FROM (SELECT event_id, value+1 x, (value-floor(value))*0.98+0.01 u FROM events)""")
def density_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, u = F.col("value") + 1, (F.col("value") - F.floor("value")) * 0.98 + 0.01
    r = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, sf_dir, "events").select(
        "event_id", r(S.normal(40.0, 10.0)[0](x), "normal_pdf"), r(S.maxwell_boltzmann(30.0)[0](x), "maxwell_boltzmann_pdf"),
        r(S.log_normal(3.0, 1.0)[0](x), "log_normal_pdf"), r(S.kumaraswamy(2.0, 3.0)[0](u), "kumaraswamy_pdf"),
    )


@query("""SELECT event_id, round((p-y)*(p-y),9) squared, round(abs(p-y),9) absolute, round(CASE WHEN abs(p-y)<=1 THEN (p-y)*(p-y)*0.5 ELSE abs(p-y)-0.5 END,9) huber, round(greatest(0,abs(p-y)-0.5),9) epsilon,
 round(greatest(0,1-s*p),9) hinge, round(ln(1+exp(-s*p)),9) logistic FROM (SELECT event_id, value/50 p, event_id%3 y, CASE WHEN event_id%2=0 THEN 1 ELSE -1 END s FROM events)""")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y, s = F.col("value") / 50, F.col("event_id") % 3, F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    r = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, sf_dir, "events").select(
        "event_id", r(S.squared_loss(p, y), "squared"), r(S.absolute_loss(p, y), "absolute"), r(S.huber_loss(p, y), "huber"),
        r(S.epsilon_insensitive_loss(p, y), "epsilon"), r(S.hinge_loss(p, s), "hinge"), r(S.logistic_loss(p, s), "logistic"),
    )


@query("""SELECT event_id, round(greatest(x,0),9) relu, round(1/(1+exp(-x)),9) sigmoid, round(tanh(x),9) tanh, round(ln(1+exp(x)),9) softplus, round(x/(1+abs(x)),9) softsign,
 round(asinh(x),9) asinh, round(1/cos(x),6) sec, round(atanh(tanh(x)*0.9),9) atanh FROM (SELECT event_id, value/50-1 x FROM events)""")
def activations_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") / 50 - 1
    r = lambda c, n, d=9: F.round(c, d).alias(n)
    return table(spark, sf_dir, "events").select(
        "event_id", r(S.relu(x), "relu"), r(S.sigmoid(x), "sigmoid"), r(F.tanh(x), "tanh"), r(S.softplus(x), "softplus"), r(S.softsign(x), "softsign"),
        r(S.asinh(x), "asinh"), r(S.sec(x), "sec", 6), r(S.atanh(F.tanh(x) * 0.9), "atanh"),
    )


@query("""SELECT event_id, 0.5::DOUBLE no_decay, round(0.5-0.4*least(t/1000,1),9) linear, round(0.5*pow(0.2,t/1000),9) exponential, round(0.5/(1+t),9) inverse, round(0.5*pow(10/(10+t),0.5),9) power
 FROM (SELECT event_id, (event_id%1000)::DOUBLE t FROM events)""")
def decay_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.col("event_id") % 1000).cast("double")
    r = lambda c, n: F.round(c, 9).alias(n)
    return table(spark, sf_dir, "events").select(
        "event_id", r(S.no_decay(t, 0.5), "no_decay"), r(S.linear_decay(t, 0.5, 0.1, 1000.0), "linear"), r(S.exponential_decay(t, 0.5, 0.1, 1000.0), "exponential"),
        r(S.inverse_decay(t, 0.5), "inverse"), r(S.power_decay(t, 0.5), "power"),
    )


# Ordered streams --------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, event_id, ts, (value>20)::INT ok, row_number() OVER w n, sum((value<=20)::INT) OVER w bad FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT *, bad/n p, sqrt(bad/n*(1-bad/n)/n) s FROM e), m AS (SELECT *, min(p+s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) low FROM r)
 SELECT user_id, event_id, n, round(p,9) rate, round(s,9) deviation, round(low,9) lowest FROM m""")
def ddm_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running error rate, its deviation and their least sum, on which drift detection rests."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.count("*").over(w).alias("n"), F.sum((F.col("value") <= 20).cast("long")).over(w).alias("bad"))
    p = F.col("bad") / F.col("n")
    e = e.withColumns({"p": p, "s": F.sqrt(p * (1 - p) / F.col("n"))})
    e = e.withColumn("low", F.min(F.col("p") + F.col("s")).over(w))
    return e.select("user_id", "event_id", "n", F.round("p", 9).alias("rate"), F.round("s", 9).alias("deviation"), F.round("low", 9).alias("lowest"))


@query("""SELECT round(sum((b.x-a.x)*(a.y+b.y)/2),9) integral FROM (SELECT i, i*0.01 x, sin(i*0.01) y FROM range(0,314) r(i)) a JOIN (SELECT i, i*0.01 x, sin(i*0.01) y FROM range(0,315) r(i)) b ON b.i=a.i+1""")
def trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(0, 315).select("id", (F.col("id") * 0.01).alias("x"), F.sin(F.col("id") * 0.01).alias("y"))
    before = x.select((F.col("id") + 1).alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    step = x.join(before, "id").select((F.col("x") - F.col("x0")).alias("dx"), (F.col("y") + F.col("y0")).alias("yy"))
    return step.agg(F.round(F.sum(F.col("dx") * F.col("yy") / 2), 9).alias("integral"))
