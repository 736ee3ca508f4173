"""Vector algebra, distances and kernels over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    """Elementwise product."""
    return F.zip_with(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Elementwise quotient."""
    return F.zip_with(a, b, lambda x, y: x / y)


def scale(v: Column, c: float | Column) -> Column:
    return F.transform(v, lambda x: x * c)


def shift(v: Column, c: float | Column) -> Column:
    return F.transform(v, lambda x: x + c)


def axpy(v: Column, c: float, b: Column) -> Column:
    """v + c * b."""
    return F.zip_with(v, b, lambda x, y: x + c * y)


def nnz(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x != 0))


def count_nans(v: Column) -> Column:
    return F.size(F.filter(v, F.isnan))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def variance(v: Column) -> Column:
    """Population variance."""
    m = mean(v)
    return total(F.transform(v, lambda x: x * x)) / F.size(v) - m * m


def median(v: Column) -> Column:
    s, n = F.sort_array(v), F.size(v)
    mid = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2)


def p_norm(v: Column, p: float) -> Column:
    return F.pow(total(F.transform(v, lambda x: F.pow(F.abs(x), F.lit(p)))), F.lit(1.0 / p))


def normalized(v: Column) -> Column:
    """v divided by its Euclidean norm."""
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1.0 / p))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def pearson_distance(a: Column, b: Column) -> Column:
    """sqrt((1 - r) / 2)."""
    n = F.size(a)
    cov = dot(a, b) / n - mean(a) * mean(b)
    return F.sqrt(F.greatest(F.lit(0.0), (1 - cov / F.sqrt(variance(a) * variance(b))) / 2))


def weighted_jaccard_distance(a: Column, b: Column) -> Column:
    """1 - sum of minima / sum of maxima of magnitudes."""
    low = total(F.zip_with(a, b, lambda x, y: F.least(F.abs(x), F.abs(y))))
    high = total(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x), F.abs(y))))
    return 1 - low / high


def rbf_kernel(a: Column, b: Column, sigma: float = 1.0) -> Column:
    return F.exp(-squared_euclidean(a, b) / (2 * sigma * sigma))


def polynomial_kernel(a: Column, b: Column, degree: float = 2.0, alpha: float = 1.0, c: float = 1.0) -> Column:
    return F.pow(alpha * dot(a, b) + c, F.lit(degree))


def linear_kernel(a: Column, b: Column, c: float = 0.0) -> Column:
    return dot(a, b) + c


def sigmoid_kernel(a: Column, b: Column, alpha: float = 1.0, c: float = 0.0) -> Column:
    return F.tanh(alpha * dot(a, b) + c)


def rational_quadratic_kernel(a: Column, b: Column, c: float = 1.0) -> Column:
    d = squared_euclidean(a, b)
    return 1 - d / (d + c)


def general_rbf_kernel(a: Column, b: Column, distance, sigma: float = 1.0) -> Column:
    """exp(-d^2 / (2 sigma^2)) over any distance of two vectors."""
    d = distance(a, b)
    return F.exp(-d * d / (2 * sigma * sigma))


def pearson_vii_kernel(a: Column, b: Column, sigma: float = 1.0, omega: float = 1.0) -> Column:
    d = euclidean(a, b) * (2 * (2 ** (1 / omega) - 1) ** 0.5 / sigma)
    return 1 / F.pow(1 + d * d, F.lit(omega))


def normalized_kernel(a: Column, b: Column, kernel) -> Column:
    """A kernel divided by the root of both vectors' own values."""
    return kernel(a, b) / F.sqrt(kernel(a, a) * kernel(b, b))


def kernel_distance(a: Column, b: Column, kernel) -> Column:
    """Squared distance in the kernel's space."""
    return kernel(a, a) - 2 * kernel(a, b) + kernel(b, b)


def weighted_euclidean(a: Column, b: Column, w: Column) -> Column:
    return F.sqrt(total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, x: d * x)))


def cosine_distance_normalized(a: Column, b: Column) -> Column:
    """The cosine distance of vectors that have length one."""
    return 1 - dot(a, b)


def mahalanobis(a: Column, b: Column, inverse) -> Column:
    """Distance under the inverse of a covariance matrix, given as rows of numbers."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in inverse])
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(d, rows, lambda x, r: x * total(F.zip_with(r, d, lambda p, q: p * q))))))


def median(v: Column) -> Column:
    s, n = F.sort_array(v), F.size(v)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def skewness(v: Column) -> Column:
    """Third central moment over (n - 1) deviations cubed, with the population's deviation."""
    m, n = mean(v), F.size(v)
    third = total(F.transform(v, lambda x: (x - m) * (x - m) * (x - m)))
    return third / (F.pow(variance(v), F.lit(1.5)) * (n - 1))


def kurtosis(v: Column) -> Column:
    """Fourth central moment over (n - 1) squared variances, less 3."""
    m, n = mean(v), F.size(v)
    fourth = total(F.transform(v, lambda x: (x - m) * (x - m) * (x - m) * (x - m)))
    return fourth / (variance(v) * variance(v) * (n - 1)) - 3


def concatenated(*vs: Column) -> Column:
    return F.concat(*vs)


def constant(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


def scaled(v: Column, c: Column | float) -> Column:
    return F.transform(v, lambda x: x * c)


def shifted(v: Column, c: Column | float) -> Column:
    return F.transform(v, lambda x: x + c)


def sub_vector(v: Column, start: int, n: int) -> Column:
    """``n`` elements from position ``start`` (from 0)."""
    return F.slice(v, start + 1, n)


def random_vector(n: int, seed: int, row: Column) -> Column:
    """``n`` numbers of [0, 1) that depend on the seed and the row's key only."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.xxhash64(F.lit(seed), row, i), F.lit(1 << 53)) / float(1 << 53))


def to_sparse(v: Column) -> Column:
    """The non-zero elements as a map from position to value."""
    entries = F.transform(v, lambda x, i: F.struct(i.alias("key"), x.alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] != 0))


def to_dense(sparse: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at(sparse, i), F.lit(0.0)))


def sparse_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.map_entries(a), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)))


def quadratic_features(v: Column) -> Column:
    """One, the elements, and all products of two elements."""
    pairs = F.flatten(F.transform(v, lambda x, i: F.transform(F.slice(v, i + 1, F.size(v)), lambda y: x * y)))
    return F.concat(F.array(F.lit(1.0)), v, pairs)


def increment(v: Column, i: int, by: Column | float) -> Column:
    return F.transform(v, lambda x, j: F.when(j == i, x + by).otherwise(x))


def count_nans(v: Column) -> Column:
    return F.size(F.filter(v, F.isnan))


def arg_sort(v: Column) -> Column:
    """Positions (from 0) in ascending order of the elements; equal ones keep their order."""
    pairs = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda p: p["i"])
