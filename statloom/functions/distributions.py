"""Distributions: density, distribution function, quantile, moments, samples and fits.

Each is one small class over NumPy arrays; ``Distribution.column`` makes any of
its functions a column. Quantiles without a closed form invert the distribution
function. Outside its support a density is 0 and its logarithm minus infinity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions import numeric as N
from statloom.functions.special import column

INF = math.inf


class Distribution:
    """A real distribution: subclasses give ``_pdf`` and ``_cdf`` inside the support."""

    def support(self) -> tuple[float, float]:
        return -INF, INF

    def _pdf(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _cdf(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def _within(self, x, f, below: float, above: float) -> np.ndarray:
        x = np.asarray(x, dtype=float)
        low, high = self.support()
        inside = (x >= low) & (x <= high) & np.isfinite(x)
        out = np.where(x < low, below, above)
        if np.any(inside):
            with np.errstate(all="ignore"):
                out = np.where(inside, f(np.where(inside, x, self._somewhere())), out)
        return np.where(np.isnan(x), np.nan, out)

    def _somewhere(self) -> float:
        low, high = self.support()
        if math.isfinite(low):
            return (low + high) / 2 if math.isfinite(high) else low + 1
        return high - 1 if math.isfinite(high) else 0.0

    def pdf(self, x) -> np.ndarray:
        return self._within(x, self._pdf, 0.0, 0.0)

    def log_pdf(self, x) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.pdf(x))

    def cdf(self, x) -> np.ndarray:
        return self._within(x, self._cdf, 0.0, 1.0)

    def quantile(self, p) -> np.ndarray:
        low, high = self.support()
        return N.inverse(self.cdf, p, low, high)

    def mean(self) -> float:
        return self._moment(lambda x: x)

    def variance(self) -> float:
        mu = self.mean()
        return self._moment(lambda x: (x - mu) ** 2)

    def skewness(self) -> float:
        mu = self.mean()
        return self._moment(lambda x: (x - mu) ** 3) / self.variance() ** 1.5

    def median(self) -> float:
        return float(self.quantile(np.array([0.5]))[0])

    def mode(self) -> float:
        """The place of the highest density, on a fine grid of quantiles."""
        x = self.quantile(np.linspace(1e-4, 1 - 1e-4, 4001))
        return float(x[int(np.argmax(self.pdf(x)))])

    def _moment(self, f) -> float:
        """Expectation by Gauss-Legendre quadrature over the quantiles."""
        nodes, weights = np.polynomial.legendre.leggauss(400)
        u = (nodes + 1) / 2
        p = u**3 * (10 - 15 * u + 6 * u * u)  # flat ends: tails are met slowly
        return float(np.sum(weights / 2 * 30 * u**2 * (1 - u) ** 2 * f(self.quantile(p))))

    def column(self, what: str, x: Column) -> Column:
        """``pdf``, ``log_pdf``, ``cdf``, ``quantile``, ``survival`` or ``hazard`` of a column."""
        return column(getattr(self, what), x)

    def survival(self, x) -> np.ndarray:
        return 1 - self.cdf(x)

    def hazard(self, x) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.pdf(x) / self.survival(x)

    def sample(self, spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
        """``id, value``: seeded samples by inversion, made where they are needed."""
        return spark.range(n).select("id", self.column("quantile", F.rand(seed)).alias("value"))


@dataclass(frozen=True)
class Normal(Distribution):
    mu: float = 0.0
    sd: float = 1.0

    def _pdf(self, x):
        return np.exp(-0.5 * ((x - self.mu) / self.sd) ** 2) / (self.sd * math.sqrt(2 * math.pi))

    def _cdf(self, x):
        return 0.5 * N.erfc(-(x - self.mu) / (self.sd * math.sqrt(2)))


@dataclass(frozen=True)
class LogNormal(Distribution):
    mu: float = 0.0
    sd: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return np.where(x > 0, Normal(self.mu, self.sd).pdf(np.log(np.maximum(x, 1e-300))) / np.maximum(x, 1e-300), 0.0)

    def _cdf(self, x):
        return np.where(x > 0, Normal(self.mu, self.sd).cdf(np.log(np.maximum(x, 1e-300))), 0.0)


@dataclass(frozen=True)
class Uniform(Distribution):
    low: float = 0.0
    high: float = 1.0

    def support(self):
        return self.low, self.high

    def _pdf(self, x):
        return np.full_like(x, 1 / (self.high - self.low))

    def _cdf(self, x):
        return (x - self.low) / (self.high - self.low)


@dataclass(frozen=True)
class LogUniform(Distribution):
    low: float = 1e-2
    high: float = 1.0

    def support(self):
        return self.low, self.high

    def _pdf(self, x):
        return 1 / (x * math.log(self.high / self.low))

    def _cdf(self, x):
        return np.log(x / self.low) / math.log(self.high / self.low)


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return self.rate * np.exp(-self.rate * x)

    def _cdf(self, x):
        return -np.expm1(-self.rate * x)


@dataclass(frozen=True)
class Laplace(Distribution):
    mu: float = 0.0
    b: float = 1.0

    def _pdf(self, x):
        return np.exp(-np.abs(x - self.mu) / self.b) / (2 * self.b)

    def _cdf(self, x):
        half = np.exp(-np.abs(x - self.mu) / self.b) / 2
        return np.where(x < self.mu, half, 1 - half)


@dataclass(frozen=True)
class Logistic(Distribution):
    mu: float = 0.0
    s: float = 1.0

    def _cdf(self, x):
        return 0.5 + 0.5 * np.tanh((x - self.mu) / (2 * self.s))

    def _pdf(self, x):
        return 1 / (4 * self.s * np.cosh((x - self.mu) / (2 * self.s)) ** 2)


@dataclass(frozen=True)
class Cauchy(Distribution):
    at: float = 0.0
    scale: float = 1.0

    def _pdf(self, x):
        return 1 / (math.pi * self.scale * (1 + ((x - self.at) / self.scale) ** 2))

    def _cdf(self, x):
        return np.arctan((x - self.at) / self.scale) / math.pi + 0.5

    def mean(self):
        return math.nan

    def variance(self):
        return math.nan


@dataclass(frozen=True)
class Levy(Distribution):
    at: float = 0.0
    scale: float = 1.0

    def support(self):
        return self.at, INF

    def _pdf(self, x):
        d = np.maximum(x - self.at, 1e-300)
        return np.sqrt(self.scale / (2 * math.pi)) * np.exp(-self.scale / (2 * d)) / d**1.5

    def _cdf(self, x):
        return N.erfc(np.sqrt(self.scale / (2 * np.maximum(x - self.at, 1e-300))))

    def mean(self):
        return INF

    def variance(self):
        return INF


@dataclass(frozen=True)
class Pareto(Distribution):
    low: float = 1.0
    alpha: float = 3.0

    def support(self):
        return self.low, INF

    def _pdf(self, x):
        return self.alpha * self.low**self.alpha / x ** (self.alpha + 1)

    def _cdf(self, x):
        return 1 - (self.low / x) ** self.alpha


@dataclass(frozen=True)
class Rayleigh(Distribution):
    sd: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return x / self.sd**2 * np.exp(-x * x / (2 * self.sd**2))

    def _cdf(self, x):
        return -np.expm1(-x * x / (2 * self.sd**2))


@dataclass(frozen=True)
class Weibull(Distribution):
    shape: float = 1.5
    scale: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        z = x / self.scale
        return self.shape / self.scale * z ** (self.shape - 1) * np.exp(-(z**self.shape))

    def _cdf(self, x):
        return -np.expm1(-((x / self.scale) ** self.shape))


@dataclass(frozen=True)
class Kumaraswamy(Distribution):
    a: float = 2.0
    b: float = 3.0

    def support(self):
        return 0.0, 1.0

    def _pdf(self, x):
        return self.a * self.b * x ** (self.a - 1) * (1 - x**self.a) ** (self.b - 1)

    def _cdf(self, x):
        return 1 - (1 - x**self.a) ** self.b


@dataclass(frozen=True)
class MaxwellBoltzmann(Distribution):
    scale: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return math.sqrt(2 / math.pi) * x * x * np.exp(-x * x / (2 * self.scale**2)) / self.scale**3

    def _cdf(self, x):
        return N.gamma_p(1.5, x * x / (2 * self.scale**2))


@dataclass(frozen=True)
class Gamma(Distribution):
    shape: float = 2.0
    scale: float = 1.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        z = np.maximum(x / self.scale, 1e-300)
        return np.exp((self.shape - 1) * np.log(z) - z - N.ln_gamma(self.shape)) / self.scale

    def _cdf(self, x):
        return N.gamma_p(self.shape, x / self.scale)


@dataclass(frozen=True)
class ChiSquared(Distribution):
    df: float = 3.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return Gamma(self.df / 2, 2.0)._pdf(x)

    def _cdf(self, x):
        return Gamma(self.df / 2, 2.0)._cdf(x)


@dataclass(frozen=True)
class Beta(Distribution):
    a: float = 2.0
    b: float = 3.0

    def support(self):
        return 0.0, 1.0

    def _pdf(self, x):
        return np.exp((self.a - 1) * np.log(np.maximum(x, 1e-300)) + (self.b - 1) * np.log(np.maximum(1 - x, 1e-300)) - N.ln_beta(self.a, self.b))

    def _cdf(self, x):
        return N.beta_inc(x, self.a, self.b)


@dataclass(frozen=True)
class FisherSnedecor(Distribution):
    df1: float = 4.0
    df2: float = 8.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        a, b, z = self.df1 / 2, self.df2 / 2, np.maximum(x, 1e-300)
        return np.exp(a * math.log(self.df1) + b * math.log(self.df2) + (a - 1) * np.log(z) - (a + b) * np.log(self.df1 * z + self.df2) - N.ln_beta(a, b))

    def _cdf(self, x):
        return N.beta_inc(self.df1 * x / (self.df1 * x + self.df2), self.df1 / 2, self.df2 / 2)


@dataclass(frozen=True)
class StudentT(Distribution):
    df: float = 5.0
    mu: float = 0.0
    sd: float = 1.0

    def _pdf(self, x):
        z = (x - self.mu) / self.sd
        v = self.df
        return np.exp(N.ln_gamma((v + 1) / 2) - N.ln_gamma(v / 2) - 0.5 * math.log(v * math.pi) - (v + 1) / 2 * np.log1p(z * z / v)) / self.sd

    def _cdf(self, x):
        z = (x - self.mu) / self.sd
        tail = 0.5 * N.beta_inc(self.df / (self.df + z * z), self.df / 2, 0.5)
        return np.where(z < 0, tail, 1 - tail)


@dataclass(frozen=True)
class Kolmogorov(Distribution):
    """The limit of sqrt(n) times the largest distance of an empirical distribution function."""

    def support(self):
        return 0.0, INF

    def _cdf(self, x):
        k = np.arange(1, 101)[:, None]
        z = np.maximum(np.atleast_1d(x).ravel(), 1e-3)
        low = math.sqrt(2 * math.pi) / z * np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)).sum(axis=0)
        high = 1 - 2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * z * z)).sum(axis=0)
        return np.where(z < 1, low, high).reshape(np.shape(x))

    def _pdf(self, x):
        k = np.arange(1, 101)[:, None]
        z = np.atleast_1d(x).ravel()
        high = 8 * z * ((-1.0) ** (k - 1) * k * k * np.exp(-2 * k * k * z * z)).sum(axis=0)
        return np.where(z < 0.15, 0.0, high).reshape(np.shape(x))


@dataclass(frozen=True)
class Truncated(Distribution):
    """A distribution restricted to an interval."""

    base: Distribution
    low: float
    high: float

    def support(self):
        return self.low, self.high

    def _mass(self):
        a, b = self.base.cdf(np.array([self.low, self.high]))
        return a, b - a

    def _pdf(self, x):
        return self.base.pdf(x) / self._mass()[1]

    def _cdf(self, x):
        a, m = self._mass()
        return (self.base.cdf(x) - a) / m


class Discrete(Distribution):
    """A distribution over integers: ``pdf`` is the probability of each."""

    def _within(self, x, f, below, above):
        x = np.asarray(x, dtype=float)
        whole = np.floor(x)
        got = super()._within(whole, f, below, above)
        return np.where(x == whole, got, 0.0) if f == self._pdf else got

    def quantile(self, p) -> np.ndarray:
        """The least integer whose distribution function reaches ``p``."""
        low, _ = self.support()
        p = np.asarray(p, dtype=float)
        return np.ceil(super().quantile(np.where(p < 1, np.maximum(p - 1e-12, 0), p)) - 1e-6 * (p < 1)).clip(low)

    def _moment(self, f) -> float:
        low, high = self.support()
        top = high if math.isfinite(high) else float(self.quantile(np.array([1 - 1e-13]))[0])
        x = np.arange(low, min(top, low + 1e7) + 1)
        return float(np.sum(self.pdf(x) * f(x)))


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int = 10
    p: float = 0.5

    def support(self):
        return 0.0, float(self.n)

    def _pdf(self, x):
        return np.exp(N.ln_gamma(self.n + 1) - N.ln_gamma(x + 1) - N.ln_gamma(self.n - x + 1) + x * math.log(self.p) + (self.n - x) * math.log1p(-self.p))

    def _cdf(self, x):
        return np.where(x >= self.n, 1.0, N.beta_inc(1 - self.p, np.maximum(self.n - x, 1e-9), x + 1))


@dataclass(frozen=True)
class Poisson(Discrete):
    rate: float = 3.0

    def support(self):
        return 0.0, INF

    def _pdf(self, x):
        return np.exp(x * math.log(self.rate) - self.rate - N.ln_gamma(x + 1))

    def _cdf(self, x):
        return N.gamma_q(x + 1, self.rate)


@dataclass(frozen=True)
class UniformDiscrete(Discrete):
    low: int = 1
    high: int = 6

    def support(self):
        return float(self.low), float(self.high)

    def _pdf(self, x):
        return np.full_like(x, 1 / (self.high - self.low + 1))

    def _cdf(self, x):
        return (x - self.low + 1) / (self.high - self.low + 1)


@dataclass(frozen=True)
class Zipf(Discrete):
    """Ranks 1 to ``n`` (without end for infinity) with weights rank ** -(skew + 1)."""

    n: float = INF
    skew: float = 1.0

    def support(self):
        return 1.0, self.n

    def _total(self, x):
        return N.harmonic(x, self.skew + 1)

    def _norm(self):
        return float(N.zeta(self.skew + 1)) if math.isinf(self.n) else float(self._total(self.n))

    def _pdf(self, x):
        return x ** -(self.skew + 1) / self._norm()

    def _cdf(self, x):
        return self._total(x) / self._norm()


def fit_all(df: DataFrame, value: str) -> dict[str, Distribution]:
    """Fits of every family that the data allow, from one aggregation over all rows."""
    x = F.col(value).cast("double")
    logs = F.log(F.when(x > 0, x))
    r = df.where(x.isNotNull() & ~F.isnan(x)).agg(
        F.count("*").alias("n"), F.avg(x).alias("mu"), F.var_pop(x).alias("var"), F.min(x).alias("low"), F.max(x).alias("high"), F.median(x).alias("median"),
        F.avg(logs).alias("lmu"), F.stddev_pop(logs).alias("lsd"), F.avg(x * x).alias("sq"), F.percentile_approx(x, [0.25, 0.75]).alias("q"),
    ).first()
    if not r.n or not r["var"] or r["var"] <= 0:
        return {}
    mu, var, sd = r.mu, r["var"], math.sqrt(r["var"])
    out: dict[str, Distribution] = {"Normal": Normal(mu, sd), "Uniform": Uniform(r.low, r.high), "Logistic": Logistic(mu, sd * math.sqrt(3) / math.pi), "Laplace": Laplace(r["median"], sd / math.sqrt(2))}
    if r.q and r.q[1] > r.q[0]:
        out["Cauchy"] = Cauchy(r["median"], (r.q[1] - r.q[0]) / 2)
    if r.low >= 0 and mu > 0:
        out |= {"Exponential": Exponential(1 / mu), "Gamma": Gamma(mu * mu / var, var / mu), "Rayleigh": Rayleigh(math.sqrt(r.sq / 2)), "MaxwellBoltzmann": MaxwellBoltzmann(math.sqrt(r.sq / 3))}
    if r.low > 0 and r.lsd:
        shape = math.pi / math.sqrt(6) / r.lsd  # by the spread of the logarithms
        out |= {"LogNormal": LogNormal(r.lmu, r.lsd), "Weibull": Weibull(shape, math.exp(r.lmu + np.euler_gamma / shape)), "LogUniform": LogUniform(r.low, r.high)}
        if r.lmu > math.log(r.low):
            out["Pareto"] = Pareto(r.low, 1 / (r.lmu - math.log(r.low)))
    if 0 <= r.low and r.high <= 1 and var < mu * (1 - mu):
        k = mu * (1 - mu) / var - 1
        out["Beta"] = Beta(mu * k, (1 - mu) * k)
    return out


def search(df: DataFrame, value: str) -> DataFrame:
    """``family, log_likelihood, n`` of every fitted family, the best first.

    One pass over the rows adds up the log densities of all families; a row
    outside a family's support makes its likelihood minus infinity.
    """
    found = fit_all(df, value)
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x))
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(d.column("log_pdf", x)).alias(name) for name, d in found.items()])
    long = sums.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), F.col(k).alias("log_likelihood")) for k in found])).alias("s")) if found else None
    if long is None:
        return df.sparkSession.createDataFrame([], "family string, log_likelihood double, n long")
    return long.select("s.family", "s.log_likelihood", "n").orderBy(F.desc("log_likelihood"), "family")
