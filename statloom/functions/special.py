"""Special functions as column expressions: closed forms stay in the JVM, series are Arrow batches of ``numeric``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.functions import numeric as N


def column(f: Callable[..., np.ndarray], *args: Column | float) -> Column:
    """A NumPy function of columns and numbers as one column; a null argument gives null."""

    @F.pandas_udf("double")
    def batch(*xs: pd.Series) -> pd.Series:
        arrays = [x.to_numpy(dtype=float, na_value=np.nan) for x in xs]
        out = np.asarray(f(*arrays), dtype=float)
        return pd.Series(np.where(np.any([np.isnan(a) for a in arrays], axis=0), np.nan, out)).astype("Float64").mask(lambda s: s.isna())

    return batch(*[(a if isinstance(a, Column) else F.lit(a)).cast("double") for a in args])


def ln_gamma(x: Column) -> Column:
    return column(N.ln_gamma, x)


def gamma(x: Column) -> Column:
    return column(N.gamma, x)


def digamma(x: Column) -> Column:
    return column(N.digamma, x)


def zeta(s: Column, a: Column | float = 1.0) -> Column:
    return column(N.zeta, s, a)


def harmonic(n: Column, m: Column | float = 1.0) -> Column:
    return column(N.harmonic, n, m)


def bernoulli(n: Column) -> Column:
    return column(N.bernoulli, n)


def ln_abs_bernoulli(n: Column) -> Column:
    return column(N.ln_abs_bernoulli, n)


def erf(x: Column) -> Column:
    return column(N.erf, x)


def erfc(x: Column) -> Column:
    return column(N.erfc, x)


def inv_erf(x: Column) -> Column:
    return column(N.inv_erf, x)


def inv_erfc(x: Column) -> Column:
    return column(N.inv_erfc, x)


def beta(a: Column, b: Column | float) -> Column:
    return column(N.beta, a, b)


def ln_beta(a: Column, b: Column | float) -> Column:
    return column(N.ln_beta, a, b)


def beta_inc(x: Column, a: Column | float, b: Column | float) -> Column:
    return column(N.beta_inc, x, a, b)


def inv_beta_inc(p: Column, a: Column | float, b: Column | float) -> Column:
    return column(N.inv_beta_inc, p, a, b)


def gamma_p(a: Column | float, x: Column) -> Column:
    return column(N.gamma_p, a, x)


def gamma_q(a: Column | float, x: Column) -> Column:
    return column(N.gamma_q, a, x)


def inv_gamma_p(p: Column, a: Column | float) -> Column:
    return column(N.inv_gamma_p, p, a)


def gamma_low(a: Column | float, x: Column) -> Column:
    """Lower incomplete gamma function, not regularised."""
    return column(lambda k, z: N.gamma_p(k, z) * N.gamma(k), a, x)


def gamma_up(a: Column | float, x: Column) -> Column:
    """Upper incomplete gamma function, not regularised."""
    return column(lambda k, z: N.gamma_q(k, z) * N.gamma(k), a, x)


def inv_x_ln_x(y: Column) -> Column:
    return column(N.inv_x_ln_x, y)


# Closed forms.
def coth(x: Column) -> Column:
    return 1 / F.tanh(x)


def sech(x: Column) -> Column:
    return 1 / F.cosh(x)


def csch(x: Column) -> Column:
    return 1 / F.sinh(x)


def acosh(x: Column) -> Column:
    return F.acosh(x)


def asech(x: Column) -> Column:
    return F.acosh(1 / x)


def acsch(x: Column) -> Column:
    return F.asinh(1 / x)


def acoth(x: Column) -> Column:
    return F.atanh(1 / x)


def horner(coefficients: Sequence[float], x: Column) -> Column:
    """A polynomial whose first coefficient is that of the highest power."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def horner_reversed(coefficients: Sequence[float], x: Column) -> Column:
    """A polynomial whose first coefficient is the constant."""
    return horner(list(reversed(coefficients)), x)


def log_sum_exp(values: Column) -> Column:
    """ln of the summed exponentials of an array, without overflow."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def softmax(values: Column, implicit_zero: bool = False) -> Column:
    """Shares of exponentials; with ``implicit_zero`` one more value of zero takes a share too."""
    xs = F.concat(values, F.array(F.lit(0.0))) if implicit_zero else values
    total = log_sum_exp(xs)
    return F.transform(values, lambda v: F.exp(v - total))


def floor_log2(x: Column) -> Column:
    """Floor of the binary logarithm of a positive integer, from its bits."""
    return (F.length(F.bin(x.cast("long"))) - 1).cast("int")


def pow2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def parse_int(text: Column, radix: int = 10) -> Column:
    """A signed integer in a radix; null if the text is none."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"[:radix]
    low = F.lower(F.trim(text))
    sign, body = F.when(low.startswith("-"), -1).otherwise(1), F.regexp_replace(low, "^[+-]", "")
    return F.when(body.rlike(f"^[{digits}]+$"), sign * F.conv(body, radix, 10).try_cast("long"))


def parse_double(text: Column) -> Column:
    """A double; null if the text is none."""
    return F.trim(text).try_cast("double")
