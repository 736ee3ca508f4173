"""Special functions over NumPy arrays, the vectorised core of the column functions in ``special``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Lanczos coefficients for g = 7, and the even Bernoulli numbers B2, B4, ...
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
_BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510, 43867 / 798, -174611 / 330)
_TINY, _EPS = 1e-300, 1e-16


def _array(*xs) -> tuple[np.ndarray, ...]:
    return tuple(x.copy() for x in np.broadcast_arrays(*[np.asarray(x, dtype=float) for x in xs]))


def ln_gamma(x) -> np.ndarray:
    """ln |gamma(x)|; infinite at the poles."""
    (x,) = _array(x)
    low = x < 0.5
    z = np.where(low, 1 - x, x) - 1
    total = np.full_like(z, _LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total += c / (z + i)
    t = z + 7.5
    with np.errstate(all="ignore"):
        big = 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total)
        return np.where(low, np.log(np.pi) - np.log(np.abs(np.sin(np.pi * x))) - big, big)


def gamma(x) -> np.ndarray:
    (x,) = _array(x)
    sign = np.where((x < 0) & (np.floor(x) % 2 != 0), -1.0, 1.0)
    with np.errstate(all="ignore"):
        return sign * np.exp(ln_gamma(x))


def digamma(x) -> np.ndarray:
    (x,) = _array(x)
    low = x < 0.5
    z, out = np.where(low, 1 - x, x), np.zeros_like(x)
    for _ in range(10):
        step = z < 10
        out -= np.where(step, 1 / np.where(step, z, 1), 0)
        z += step
    inverse = 1 / (z * z)
    series, power = np.zeros_like(z), inverse.copy()
    for k, b in enumerate(_BERNOULLI[:7], 1):
        series += b / (2 * k) * power
        power *= inverse
    out += np.log(z) - 0.5 / z - series
    with np.errstate(all="ignore"):
        return np.where(low, out - np.pi / np.tan(np.pi * x), out)


def ln_beta(a, b) -> np.ndarray:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(np.asarray(a, float) + np.asarray(b, float))


def beta(a, b) -> np.ndarray:
    return np.exp(ln_beta(a, b))


def _gamma_series(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    term = 1 / a
    total = term.copy()
    for n in range(1, 2000):
        term = term * x / (a + n)
        total += term
        if np.all(np.abs(term) <= _EPS * np.abs(total)):
            break
    with np.errstate(all="ignore"):
        return np.where(x > 0, total * np.exp(a * np.log(np.maximum(x, _TINY)) - x - ln_gamma(a)), 0.0)


def _gamma_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x) by a continued fraction."""
    b = x + 1 - a
    c, d = np.full_like(x, 1 / _TINY), 1 / np.where(b == 0, _TINY, b)
    h = d.copy()
    for n in range(1, 2000):
        an = n * (a - n)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        delta = c * d
        h = h * delta
        if np.all(np.abs(delta - 1) < _EPS * 10):
            break
    return h * np.exp(a * np.log(x) - x - ln_gamma(a))


def gamma_p(a, x) -> np.ndarray:
    """Lower regularised incomplete gamma function."""
    a, x = _array(a, x)
    low = x < a + 1
    out = np.full_like(x, np.nan)
    ok = (x >= 0) & (a > 0) & np.isfinite(x)
    i = low & ok
    if i.any():
        out[i] = _gamma_series(a[i], x[i])
    i = ~low & ok
    if i.any():
        out[i] = 1 - _gamma_fraction(a[i], x[i])
    out[np.isposinf(x)] = 1.0
    return out


def gamma_q(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function."""
    a, x = _array(a, x)
    out = 1 - gamma_p(a, x)
    i = (x >= a + 1) & (a > 0) & np.isfinite(x)
    if i.any():
        out[i] = _gamma_fraction(a[i], x[i])
    return out


def erf(x) -> np.ndarray:
    (x,) = _array(x)
    return np.sign(x) * gamma_p(0.5, x * x)


def erfc(x) -> np.ndarray:
    (x,) = _array(x)
    q = gamma_q(0.5, x * x)
    return np.where(x >= 0, q, 2 - q)


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    guard = lambda v: np.where(np.abs(v) < _TINY, _TINY, v)
    c, d = np.ones_like(x), 1 / guard(1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 1000):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / guard(1 + an * d)
            c = guard(1 + an / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < _EPS * 10):
            break
    return h


def beta_inc(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function of x in [0, 1]."""
    x, a, b = _array(x, a, b)
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    i = (x > 0) & (x < 1)
    if i.any():
        xi, ai, bi = x[i], a[i], b[i]
        turn = xi > (ai + 1) / (ai + bi + 2)
        p, q, z = np.where(turn, bi, ai), np.where(turn, ai, bi), np.where(turn, 1 - xi, xi)
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - ln_beta(p, q)) / p
        got = front * _beta_fraction(z, p, q)
        out[i] = np.where(turn, 1 - got, got)
    return out


def inverse(f: Callable[[np.ndarray], np.ndarray], p, low, high, rounds: int = 200) -> np.ndarray:
    """Where the growing ``f`` reaches ``p``; infinite ends are searched by doubling."""
    p, low, high = _array(p, low, high)
    ok = (p >= 0) & (p <= 1)
    a = np.where(np.isfinite(low), low, np.where(np.isfinite(high), high - 1, -1.0))
    b = np.where(np.isfinite(high), high, np.where(np.isfinite(low), low + 1, 1.0))
    for _ in range(1100):
        wider = ~np.isfinite(high) & (f(b) < p) & ok & (np.abs(b) < 1e300)
        if not wider.any():
            break
        a = np.where(wider, np.maximum(a, np.where(np.isfinite(low), a, b)), a)
        b = np.where(wider, b + np.maximum(np.abs(b), 1), b)
    for _ in range(1100):
        wider = ~np.isfinite(low) & (f(a) > p) & ok & (np.abs(a) < 1e300)
        if not wider.any():
            break
        a = np.where(wider, a - np.maximum(np.abs(a), 1), a)
    for _ in range(rounds):
        m = a + (b - a) / 2
        up = f(m) < p
        a, b = np.where(up, m, a), np.where(up, b, m)
    out = a + (b - a) / 2
    return np.where(ok, np.where(p == 0, low, np.where(p == 1, high, out)), np.nan)


def inv_erf(y) -> np.ndarray:
    (y,) = _array(y)
    half = inverse(erf, np.abs(y), 0.0, np.inf)
    return np.sign(y) * np.where(np.abs(y) == 1, np.inf, half)


def inv_erfc(y) -> np.ndarray:
    (y,) = _array(y)
    return inv_erf(1 - y)


def inv_gamma_p(p, a) -> np.ndarray:
    p, a = _array(p, a)
    return inverse(lambda x: gamma_p(a, x), p, 0.0, np.inf)


def inv_beta_inc(p, a, b) -> np.ndarray:
    p, a, b = _array(p, a, b)
    return inverse(lambda x: beta_inc(x, a, b), p, 0.0, 1.0)


def inv_x_ln_x(y) -> np.ndarray:
    """The x > 1/e with x * ln x = y (y >= -1/e), by Newton's method."""
    (y,) = _array(y)
    x = np.where(y > 1, np.maximum(y / np.log(np.maximum(y, 1.5) + 1), 1.5), 1 + y / 2 + 0.5)
    x = np.maximum(x, np.exp(-1) + 1e-9)
    for _ in range(100):
        x = np.maximum(x - (x * np.log(x) - y) / np.maximum(np.log(x) + 1, 1e-12), np.exp(-1) + 1e-15)
    return np.where(y < -np.exp(-1), np.nan, x)


def zeta(s, a=1.0) -> np.ndarray:
    """Hurwitz zeta function for s > 1 and a > 0 (Riemann's for a = 1) by Euler-Maclaurin summation."""
    s, a = _array(s, a)
    n = 15
    out = sum((a + k) ** -s for k in range(n))
    z = a + n
    out = out + z ** (1 - s) / (s - 1) + 0.5 * z**-s
    rising, power, fact = s.copy(), z ** (-s - 1), 2.0
    for k, b in enumerate(_BERNOULLI, 1):
        out = out + b / fact * rising * power
        rising = rising * (s + 2 * k - 1) * (s + 2 * k)
        power = power / (z * z)
        fact *= (2 * k + 1) * (2 * k + 2)
    return np.where(s > 1, out, np.nan)


def harmonic(n, m=1.0) -> np.ndarray:
    """Generalised harmonic numbers: sum of k**-m for k = 1 to n."""
    n, m = _array(n, m)
    plain = digamma(n + 1) + np.euler_gamma
    with np.errstate(all="ignore"):
        return np.where(m == 1, plain, zeta(m) - zeta(m, n + 1))


def bernoulli(n) -> np.ndarray:
    """Bernoulli numbers, with B1 = -1/2."""
    (n,) = _array(n)
    even = (n >= 2) & (n % 2 == 0)
    known = np.array((0.0, *_BERNOULLI))[np.clip(np.where(even, n / 2, 0), 0, len(_BERNOULLI)).astype(int)]
    with np.errstate(all="ignore"):
        big = np.where((n / 2) % 2 == 1, 1, -1) * 2 * np.exp(ln_gamma(n + 1) - n * np.log(2 * np.pi)) * zeta(np.maximum(n, 2.0))
    return np.where(n == 0, 1.0, np.where(n == 1, -0.5, np.where(even, np.where(n <= 20, known, big), 0.0)))


def ln_abs_bernoulli(n) -> np.ndarray:
    """ln |B_n| of an even n."""
    with np.errstate(all="ignore"):
        return np.log(np.abs(bernoulli(n)))
