"""Queries over special functions, distributions, tests with p-values, kernels and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import distributions as D
from statloom.functions import special as S
from statloom.functions import vec as V
from statloom.operators import hypothesis
from statloom.queries_vectors import _E, _vectors
from statloom.registry import query, table


def _simpson(f: str, low: str, high: str, n: int = 400) -> str:
    """SQL for the integral of ``f`` (over t) from ``low`` to ``high``."""
    t = f"({low} + ({high} - ({low})) * i / {n}.0)"
    w = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(SELECT sum({w} * ({f.replace('#t', t)})) * ({high} - ({low})) / {3 * n} FROM range(0, {n + 1}) r(i))"


_X = "(SELECT n_nationkey k, n_nationkey / 5.0 + 0.1 x FROM nation)"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") / 5.0 + 0.1).alias("x"))


def _rounded(df: DataFrame, keep: tuple[str, ...] = ("k",), digits: int = 6) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.round(c, digits).alias(c) for c in df.columns])


_ERF = f"2 / sqrt(pi()) * {_simpson('exp(-#t * #t)', '0', 'x')}"


@query(f"""SELECT k, round(ln(gamma(x)),6) ln_gamma, round(gamma(x),6) gamma, round((lgamma(x + 1e-5) - lgamma(x - 1e-5)) / 2e-5, 4) digamma, round({_ERF},6) erf, round(1 - {_ERF},6) erfc,
 round(lgamma(x) + lgamma(2.5) - lgamma(x + 2.5),6) ln_beta, round(gamma(x) * gamma(2.5) / gamma(x + 2.5),6) beta FROM {_X}""")
def gamma_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    made = _points(spark, sf_dir).select("k", S.ln_gamma(x).alias("ln_gamma"), S.gamma(x).alias("gamma"), S.digamma(x).alias("digamma"), S.erf(x).alias("erf"), S.erfc(x).alias("erfc"), S.ln_beta(x, 2.5).alias("ln_beta"), S.beta(x, 2.5).alias("beta"))
    return _rounded(made).withColumn("digamma", F.round("digamma", 4))


@query(f"""SELECT k, round({_simpson('pow(#t, 1.5) * exp(-#t)', '0', 'x', 2000)} / gamma(2.5),6) p, round(1 - {_simpson('pow(#t, 1.5) * exp(-#t)', '0', 'x', 2000)} / gamma(2.5),6) q,
 round({_simpson('pow(#t, 1.5) * exp(-#t)', '0', 'x', 2000)},6) low, round(gamma(2.5) - {_simpson('pow(#t, 1.5) * exp(-#t)', '0', 'x', 2000)},6) up,
 round({_simpson('#t * #t * pow(1 - #t, 1.5)', '0', 'x / 5', 2000)} * gamma(5.5) / (gamma(3) * gamma(2.5)),6) i FROM {_X}""")
def incomplete_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _rounded(_points(spark, sf_dir).select("k", S.gamma_p(2.5, x).alias("p"), S.gamma_q(2.5, x).alias("q"), S.gamma_low(2.5, x).alias("low"), S.gamma_up(2.5, x).alias("up"), S.beta_inc(x / 5, 3.0, 2.5).alias("i")))


@query(f"SELECT k, round(x,6) erf, round(x,6) erfc, round(x,6) gamma_p, round(x / 5,6) beta, round(x,6) x_ln_x FROM {_X}")
def inverse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inverse takes its function's value back to the argument."""
    x = F.col("x")
    p = _points(spark, sf_dir).select("k", (x / 5).alias("u"), x.alias("x"), F.least(x, F.lit(2.5)).alias("low"))
    made = p.select("k", (S.inv_erf(S.erf(F.col("low"))) + (F.col("x") - F.col("low"))).alias("erf"), (S.inv_erfc(S.erfc(F.col("low"))) + (F.col("x") - F.col("low"))).alias("erfc"), S.inv_gamma_p(S.gamma_p(3.0, F.col("x")), 3.0).alias("gamma_p"), S.inv_beta_inc(S.beta_inc(F.col("u"), 2.0, 3.0), 2.0, 3.0).alias("beta"))
    back = S.inv_x_ln_x(F.greatest(F.col("x"), F.lit(0.5)) * F.log(F.greatest(F.col("x"), F.lit(0.5)))) - F.greatest(F.col("x"), F.lit(0.5)) + F.col("x")
    return _rounded(made.join(p.select("k", back.alias("x_ln_x")), "k"))


@query("""WITH t AS (SELECT n_nationkey k, n_nationkey + 1 n, 1.5 + n_nationkey / 5.0 s FROM nation)
 SELECT k, round((SELECT sum(pow(j, -s)) FROM range(1, 4001) r(j)) + pow(4000, 1 - s) / (s - 1) - 0.5 * pow(4000, -s) + s / 12 * pow(4000, -s - 1),6) zeta,
 round((SELECT sum(1.0 / j) FROM range(1, 26) r(j) WHERE j <= n),6) harmonic, round((SELECT sum(1.0 / (j * j)) FROM range(1, 26) r(j) WHERE j <= n),6) harmonic2,
 round(CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN -0.5 WHEN k % 2 = 1 THEN 0 ELSE (CASE WHEN (k // 2) % 2 = 1 THEN 1 ELSE -1 END) * 2 * gamma(k + 1) / pow(2 * pi(), k) * (SELECT sum(pow(j, -k::DOUBLE)) FROM range(1, 20001) r(j)) END, 3) bernoulli FROM t""")
def number_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeta, harmonic and Bernoulli numbers."""
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") + 1).alias("n"), (1.5 + F.col("n_nationkey") / 5.0).alias("s"))
    made = t.select("k", S.zeta(F.col("s")).alias("zeta"), S.harmonic(F.col("n")).alias("harmonic"), S.harmonic(F.col("n"), 2.0).alias("harmonic2"), S.bernoulli(F.col("k")).alias("bernoulli"))
    return _rounded(made).withColumn("bernoulli", F.round("bernoulli", 3))


@query(f"""SELECT k, round(cosh(x)/sinh(x),6) coth, round(1/cosh(x),6) sech, round(1/sinh(x),6) csch, round(ln(1+x+sqrt((1+x)*(1+x)-1)),6) acosh, round(ln((1+sqrt(1-pow(x/6,2)))/(x/6)),6) asech, round(ln(1/x+sqrt(1/(x*x)+1)),6) acsch,
 round(0.5*ln((2+x)/x),6) acoth, round(2*x*x*x-x+3,6) horner, round(2-x*x+3*x*x*x,6) reversed, floor(log2(k + 1))::INT floor_log2, pow(2, k % 5) pow2 FROM {_X}""")
def hyperbolic_and_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    return _points(spark, sf_dir).select(
        "k", F.round(S.coth(x), 6).alias("coth"), F.round(S.sech(x), 6).alias("sech"), F.round(S.csch(x), 6).alias("csch"), F.round(S.acosh(1 + x), 6).alias("acosh"), F.round(S.asech(x / 6), 6).alias("asech"), F.round(S.acsch(x), 6).alias("acsch"),
        F.round(S.acoth(1 + x), 6).alias("acoth"), F.round(S.horner([2, 0, -1, 3], x), 6).alias("horner"), F.round(S.horner_reversed([2, 0, -1, 3], x), 6).alias("reversed"), S.floor_log2(F.col("k") + 1).alias("floor_log2"), S.pow2(F.col("k") % 5).alias("pow2"),
    )


@query("SELECT p_partkey, TRY_CAST(p_partkey AS BIGINT) dec, ('0x' || hex(p_partkey))::BIGINT hex, NULL::BIGINT bad, TRY_CAST(p_retailprice::VARCHAR AS DOUBLE) price, TRY_CAST(p_brand AS DOUBLE) brand FROM part")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part")
    return x.select("p_partkey", S.parse_int(F.col("p_partkey").cast("string")).alias("dec"), S.parse_int(F.hex("p_partkey"), 16).alias("hex"), S.parse_int(F.lit("12x")).alias("bad"), S.parse_double(F.col("p_retailprice").cast("string")).alias("price"), S.parse_double(F.col("p_brand")).alias("brand"))


# name, distribution, density in SQL over #t, where the integral starts
_FAMILIES = (
    ("normal", D.Normal(1.5, 2.0), "exp(-pow((#t - 1.5) / 2, 2) / 2) / (2 * sqrt(2 * pi()))", "-18.5"),
    ("log_normal", D.LogNormal(0.2, 0.5), "exp(-pow((ln(greatest(#t, 1e-9)) - 0.2) / 0.5, 2) / 2) / (greatest(#t, 1e-9) * 0.5 * sqrt(2 * pi()))", "0"),
    ("gamma", D.Gamma(3.5, 0.7), "pow(#t / 0.7, 2.5) * exp(-#t / 0.7) / (0.7 * gamma(3.5))", "0"),
    ("chi_squared", D.ChiSquared(5.0), "pow(#t, 1.5) * exp(-#t / 2) / (pow(2, 2.5) * gamma(2.5))", "0"),
    ("student_t", D.StudentT(6.0), "gamma(3.5) / (sqrt(6 * pi()) * gamma(3)) * pow(1 + #t * #t / 6, -3.5)", None),
    ("maxwell_boltzmann", D.MaxwellBoltzmann(1.3), "sqrt(2 / pi()) * #t * #t * exp(-#t * #t / 3.38) / 2.197", "0"),
    ("fisher_snedecor", D.FisherSnedecor(6.0, 9.0), "216 * pow(9, 4.5) * #t * #t / (pow(6 * #t + 9, 7.5) * gamma(3) * gamma(4.5) / gamma(7.5))", "0"),
    ("levy", D.Levy(0.0, 1.2), "sqrt(1.2 / (2 * pi())) * exp(-0.6 / greatest(#t, 1e-3)) / pow(greatest(#t, 1e-3), 1.5)", "0"),
    ("beta", D.Beta(2.5, 3.5), "pow(#t, 1.5) * pow(1 - #t, 2.5) * gamma(6) / (gamma(2.5) * gamma(3.5))", "0"),
    ("kumaraswamy", D.Kumaraswamy(2.0, 3.0), "6 * #t * pow(1 - #t * #t, 2)", "0"),
    ("truncated", D.Truncated(D.Normal(1.5, 2.0), 0.0, 6.0), None, None),
)


def _family_sql() -> str:
    out = []
    for name, _, f, low in _FAMILIES:
        unit = name in ("beta", "kumaraswamy")
        x = "x / 5" if unit else "x"
        if name == "truncated":
            base = _FAMILIES[0][2]
            mass = _simpson(base, "0", "6", 1000)
            cdf, pdf = f"{_simpson(base, '0', x, 1000)} / {mass}", f"({base.replace('#t', x)}) / {mass}"
        else:
            start, add = ("0", "0.5 + ") if low is None else (low, "")
            cdf, pdf = f"{add}{_simpson(f, start, x, 2000)}", f.replace("#t", x)
        out.append(f"SELECT '{name}' family, k, round({pdf},6) pdf, round({cdf},6) cdf, round({x},6) quantile FROM {_X}")
    return " UNION ALL ".join(out)


@query(_family_sql())
def distribution_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density, distribution function, and the quantile of the latter, of distributions on special functions."""
    p, out = _points(spark, sf_dir), None
    for name, dist, _, _ in _FAMILIES:
        x = F.col("x") / 5 if name in ("beta", "kumaraswamy") else F.col("x")
        one = p.select(F.lit(name).alias("family"), "k", x.alias("x")).withColumn("cdf", dist.column("cdf", F.col("x")))
        one = one.select("family", "k", F.round(dist.column("pdf", F.col("x")), 6).alias("pdf"), F.round("cdf", 6).alias("cdf"), F.round(dist.column("quantile", F.col("cdf")), 6).alias("quantile"))
        out = one if out is None else out.unionByName(one)
    return out


_CLOSED = (
    ("exponential", D.Exponential(0.7), "-ln(1-p)/0.7"),
    ("laplace", D.Laplace(1.0, 2.0), "CASE WHEN p < 0.5 THEN 1 + 2*ln(2*p) ELSE 1 - 2*ln(2-2*p) END"),
    ("logistic", D.Logistic(1.0, 2.0), "1 + 2*ln(p/(1-p))"),
    ("pareto", D.Pareto(2.0, 3.0), "2/pow(1-p, 1.0/3)"),
    ("rayleigh", D.Rayleigh(1.5), "sqrt(-2*2.25*ln(1-p))"),
    ("weibull", D.Weibull(1.5, 2.0), "2*pow(-ln(1-p), 1/1.5)"),
    ("uniform", D.Uniform(2.0, 5.0), "2 + 3*p"),
    ("cauchy", D.Cauchy(1.0, 2.0), "1 + 2*tan(pi()*(p-0.5))"),
    ("kumaraswamy", D.Kumaraswamy(2.0, 3.0), "sqrt(1-pow(1-p, 1.0/3))"),
    ("log_uniform", D.LogUniform(0.5, 8.0), "0.5*pow(16, p)"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' family, n_nationkey k, round({q},5) quantile FROM (SELECT n_nationkey, (n_nationkey + 0.5) / 25 p FROM nation)" for n, _, q in _CLOSED))
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") + 0.5) / 25).alias("p"))
    out = None
    for name, dist, _ in _CLOSED:
        one = p.select(F.lit(name).alias("family"), "k", F.round(dist.column("quantile", F.col("p")), 5).alias("quantile"))
        out = one if out is None else out.unionByName(one)
    return out


_DISCRETE = (
    ("binomial", D.Binomial(20, 0.3), "gamma(21) / (gamma(j + 1) * gamma(21 - j)) * pow(0.3, j) * pow(0.7, 20 - j)", 0, 20),
    ("poisson", D.Poisson(3.5), "pow(3.5, j) * exp(-3.5) / gamma(j + 1)", 0, 30),
    ("uniform_discrete", D.UniformDiscrete(1, 20), "1 / 20.0", 1, 20),
    ("zipf", D.Zipf(20, 0.5), "pow(j, -1.5) / (SELECT sum(pow(q, -1.5)) FROM range(1, 21) z(q))", 1, 20),
)


@query(" UNION ALL ".join(
    f"SELECT '{n}' family, k, round(coalesce((SELECT any_value({f}) FROM range({a}, {b + 1}) r(j) WHERE j = k), 0),6) pmf, round(least(1, coalesce((SELECT sum({f}) FROM range({a}, {b + 1}) r(j) WHERE j <= k), 0)),6) cdf FROM (SELECT n_nationkey k FROM nation)"
    for n, _, f, a, b in _DISCRETE))
def discrete_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, out = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), None
    for name, dist, *_ in _DISCRETE:
        one = p.select(F.lit(name).alias("family"), "k", F.round(dist.column("pdf", F.col("k")), 6).alias("pmf"), F.round(dist.column("cdf", F.col("k")), 6).alias("cdf"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH s AS (SELECT event_type, count(value) n, (avg(value) - 5) * sqrt(count(value)) / stddev_pop(value) x, (avg(value) - 5) * sqrt(count(value)) / 10 z FROM events GROUP BY 1)
 SELECT event_type, n, round(x,6) t, round(z,6) z, round(2 * (0.5 - exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * {_simpson('pow(1 + #t * #t / (n - 1), -n / 2.0)', '0', 'least(abs(x), 40)', 4000)}),6) p_t,
 round(0.5 + {_simpson('exp(-#t * #t / 2)', '0', 'greatest(least(z, 12), -12)', 2000)} / sqrt(2 * pi()),6) p_z FROM s""")
def t_and_z_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events")
    t = hypothesis.t_test(x, "value", 5.0, ["event_type"]).select("event_type", "n", F.round("statistic", 6).alias("t"), F.round("p_value", 6).alias("p_t"))
    z = hypothesis.z_test(x, "value", 5.0, 10.0, ["event_type"], "less").select("event_type", F.round("statistic", 6).alias("z"), F.round("p_value", 6).alias("p_z"))
    return t.join(z, "event_type")


_KS_P = "(SELECT round(CASE WHEN x < 0.5 THEN 1.0 ELSE 2 * sum(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * j * j * x * x)) END, 6) FROM range(1, 60) r(j))"


@query(f"""WITH e AS (SELECT value v, count(*) c FROM events WHERE value IS NOT NULL GROUP BY 1), r AS (SELECT v, c, sum(c) OVER (ORDER BY v) u, sum(c) OVER () n FROM e),
 f AS (SELECT n, max(greatest(abs(u / n - (1 - exp(-v / 50))), abs((u - c) / n - (1 - exp(-v / 50))))) d FROM (SELECT v, c, u, n::DOUBLE n FROM r WHERE v >= 0) GROUP BY 1)
 SELECT n::BIGINT n, round(d,9) d, {_KS_P} p_value FROM (SELECT n, d, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d x FROM f)""")
def ks_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are event values exponential with mean 50?"""
    out = hypothesis.ks_one_sample(table(spark, sf_dir, "events").where("value is null or value >= 0"), "value", D.Exponential(1 / 50))
    return out.select("n", F.round("d", 9).alias("d"), F.round("p_value", 6).alias("p_value"))


@query(f"""WITH e AS (SELECT value v, sum((event_type='click')::INT) a, sum((event_type='view')::INT) b FROM events WHERE event_type IN ('click','view') AND value IS NOT NULL GROUP BY 1),
 r AS (SELECT sum(a) OVER (ORDER BY v) ca, sum(b) OVER (ORDER BY v) cb, sum(a) OVER () n1, sum(b) OVER () n2 FROM e), f AS (SELECT n1, n2, max(abs(ca/n1-cb/n2)) d, n1 * n2 / (n1 + n2)::DOUBLE m FROM r GROUP BY 1, 2)
 SELECT n1::BIGINT n1, n2::BIGINT n2, round(d,9) d, {_KS_P} p_value FROM (SELECT n1, n2, d, (sqrt(m) + 0.12 + 0.11 / sqrt(m)) * d x FROM f)""")
def ks_click_and_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hypothesis.ks_two_sample(table(spark, sf_dir, "events"), "value", "event_type", "click", "view")
    return out.select("n1", "n2", F.round("d", 9).alias("d"), F.round("p_value", 6).alias("p_value"))


@query("""WITH s AS (SELECT avg(value) mu, stddev_pop(value) sd, min(value) lo, max(value) hi, count(*) n FROM events WHERE value IS NOT NULL)
 SELECT 'Exponential' family, round(n * (-ln(mu) - 1) / n,5) mean_log_likelihood FROM s UNION ALL SELECT 'Normal', round(-ln(sd) - 0.5 * ln(2 * pi()) - 0.5,5) FROM s UNION ALL SELECT 'Uniform', round(-ln(hi - lo),5) FROM s""")
def fitted_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log likelihood of the families whose fits have a closed form, among all that are searched."""
    found = D.search(table(spark, sf_dir, "events"), "value").where(F.col("family").isin("Exponential", "Normal", "Uniform"))
    return found.select("family", F.round(F.col("log_likelihood") / F.col("n"), 5).alias("mean_log_likelihood"))


_PAIR = f"(SELECT a.id, a.v x, b.v y FROM {_E} a JOIN (SELECT v FROM {_E} WHERE id = (SELECT min(id) FROM {_E})) b ON true)"
_SQ = "list_sum(list_transform(list_zip(x, y), lambda p: pow(p[1] - p[2], 2)))"
_DOT = "list_dot_product(x, y)"


@query(f"""SELECT id, round(exp(-pow(list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2]))), 2) / 8),6) general_rbf, round(1 / (1 + pow(sqrt({_SQ}) * 2 * sqrt(2 - 1) / 1.5, 2)),6) puk,
 round(pow({_DOT} + 1, 2) / sqrt(pow(list_dot_product(x, x) + 1, 2) * pow(list_dot_product(y, y) + 1, 2)),6) normalized, round(2 - 2 * exp(-{_SQ} / 2),6) kernel_distance, round({_DOT} + 0.5,6) linear, round({_SQ} - 0.0,6) sq,
 round(sqrt(2 * {_SQ}),6) weighted, round(1 - {_DOT} / sqrt(list_dot_product(x, x) * list_dot_product(y, y)),6) cosine_normalized FROM {_PAIR}""")
def more_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels and distances of every vector from the first one."""
    x = _vectors(spark, sf_dir)
    one = x.orderBy("id").limit(1).select(F.col("vec").alias("y"))  # one row
    a, b = F.col("vec"), F.col("y")
    made = x.join(F.broadcast(one)).select(
        "id", V.general_rbf_kernel(a, b, V.manhattan, 2.0).alias("general_rbf"), V.pearson_vii_kernel(a, b, 1.5, 1.0).alias("puk"), V.normalized_kernel(a, b, lambda p, q: V.polynomial_kernel(p, q, 2.0)).alias("normalized"),
        V.kernel_distance(a, b, lambda p, q: V.rbf_kernel(p, q, 1.0)).alias("kernel_distance"), V.linear_kernel(a, b, 0.5).alias("linear"), V.squared_euclidean(a, b).alias("sq"),
        V.weighted_euclidean(a, b, V.scaled(V.constant(1.0, 64), 2.0)).alias("weighted"), V.cosine_distance_normalized(V.normalized(a), V.normalized(b)).alias("cosine_normalized"),
    )
    return _rounded(made, ("id",))


@query(f"""SELECT id, round(list_aggregate(v, 'median'),6) median, round(list_sum(list_transform(v, lambda x: pow(x - m, 3))) / (pow(s, 1.5) * (n - 1)),6) skewness, round(list_sum(list_transform(v, lambda x: pow(x - m, 4))) / (s * s * (n - 1)) - 3,6) kurtosis,
 round(sqrt(list_sum(list_transform(v, lambda x: abs(x) * x * x))::DOUBLE),6) half, round(list_sum(v[3:7]) * 2 + 5,6) sub, 2 * n len, round(list_sum(list_filter(v, lambda x: x <> 0)),6) sparse, round((pow(list_sum(v), 2) + list_dot_product(v, v)) / 2 + list_sum(v) + 1,4) quadratic, round(v[1] + 1,6) first
 FROM (SELECT id, v, len(v) n, list_avg(v) m, list_var_pop(v) s FROM {_E})""")
def vector_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec")
    return _vectors(spark, sf_dir).select(
        "id", F.round(V.median(v), 6).alias("median"), F.round(V.skewness(v), 6).alias("skewness"), F.round(V.kurtosis(v), 6).alias("kurtosis"), F.round(F.pow(V.p_norm(v, 3.0), F.lit(1.5)), 6).alias("half"),
        F.round(V.total(V.shifted(V.scaled(V.sub_vector(v, 2, 5), 2.0), 1.0)), 6).alias("sub"), F.size(V.concatenated(v, v)).cast("long").alias("len"), F.round(V.total(V.to_dense(V.to_sparse(v), 64)), 6).alias("sparse"),
        F.round(V.total(V.quadratic_features(v)), 4).alias("quadratic"), F.round(F.element_at(V.increment(v, 0, 1.0), 1), 6).alias("first"),
    )


def mahalanobis_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Inverse covariance of a few columns, from one aggregation."""
    row = df.agg(*[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).first()
    return np.linalg.inv(np.array(row, dtype=float).reshape(len(columns), -1))


@query("""WITH s AS (SELECT avg(l_quantity) m, avg(l_discount) p, var_pop(l_quantity) a, var_pop(l_discount) b, covar_pop(l_quantity, l_discount) c FROM lineitem)
 SELECT l_returnflag, round(avg(sqrt((b * pow(l_quantity - m, 2) - 2 * c * (l_quantity - m) * (l_discount - p) + a * pow(l_discount - p, 2)) / (a * b - c * c))),6) mahalanobis FROM lineitem, s GROUP BY 1""")
def mahalanobis_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    inv = mahalanobis_matrix(x, ["l_quantity", "l_discount"])
    m = x.agg(F.avg("l_quantity").alias("m"), F.avg("l_discount").alias("p"))  # one row
    d = V.mahalanobis(F.array("l_quantity", "l_discount"), F.array("m", "p"), inv.tolist())
    return x.join(F.broadcast(m)).groupBy("l_returnflag").agg(F.round(F.avg(d), 6).alias("mahalanobis"))


