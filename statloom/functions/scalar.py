"""Scalar families as column expressions: distributions, losses, activations, decay rates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAU = 2 * math.pi


def _inside(test: Column, value: Column, outside: float = 0.0) -> Column:
    return F.when(test, value).otherwise(F.lit(outside))


# Distributions: name -> (pdf, cdf), each a function of a column.
def normal(mu: float, sd: float):
    return lambda x: F.exp(-(x - mu) * (x - mu) / (2 * sd * sd)) / (sd * math.sqrt(_TAU)), None


def exponential(rate: float):
    return lambda x: _inside(x >= 0, rate * F.exp(-rate * x)), lambda x: _inside(x >= 0, 1 - F.exp(-rate * x))


def laplace(mu: float, b: float):
    return lambda x: F.exp(-F.abs(x - mu) / b) / (2 * b), lambda x: F.when(x < mu, F.exp((x - mu) / b) / 2).otherwise(1 - F.exp(-(x - mu) / b) / 2)


def logistic(mu: float, s: float):
    def cdf(x: Column) -> Column:
        return 1 / (1 + F.exp(-(x - mu) / s))

    return lambda x: cdf(x) * (1 - cdf(x)) / s, cdf


def pareto(low: float, alpha: float):
    return lambda x: _inside(x >= low, alpha * low**alpha / F.pow(x, F.lit(alpha + 1))), lambda x: _inside(x >= low, 1 - F.pow(low / x, F.lit(alpha)))


def rayleigh(sd: float):
    return lambda x: _inside(x >= 0, x / sd**2 * F.exp(-x * x / (2 * sd * sd))), lambda x: _inside(x >= 0, 1 - F.exp(-x * x / (2 * sd * sd)))


def weibull(shape: float, size: float):
    return (
        lambda x: _inside(x >= 0, shape / size * F.pow(x / size, F.lit(shape - 1)) * F.exp(-F.pow(x / size, F.lit(shape)))),
        lambda x: _inside(x >= 0, 1 - F.exp(-F.pow(x / size, F.lit(shape)))),
    )


def uniform(low: float, high: float):
    return lambda x: _inside((x >= low) & (x <= high), F.lit(1 / (high - low))), lambda x: F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def cauchy(at: float, scale: float):
    return lambda x: 1 / (math.pi * scale * (1 + F.pow((x - at) / scale, F.lit(2.0)))), lambda x: F.atan((x - at) / scale) / math.pi + 0.5


def kumaraswamy(a: float, b: float):
    inner = lambda x: (x > 0) & (x < 1)
    return (
        lambda x: _inside(inner(x), a * b * F.pow(x, F.lit(a - 1)) * F.pow(1 - F.pow(x, F.lit(a)), F.lit(b - 1))),
        lambda x: F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(1 - F.pow(1 - F.pow(x, F.lit(a)), F.lit(b))),
    )


def log_uniform(low: float, high: float):
    span = math.log(high / low)
    return lambda x: _inside((x >= low) & (x <= high), 1 / (x * span)), lambda x: F.when(x < low, 0.0).when(x > high, 1.0).otherwise((F.log(x) - math.log(low)) / span)


def maxwell_boltzmann(s: float):
    return lambda x: _inside(x >= 0, math.sqrt(2 / math.pi) * x * x * F.exp(-x * x / (2 * s * s)) / s**3), None


def log_normal(mu: float, sd: float):
    return lambda x: _inside(x > 0, F.exp(-F.pow(F.log(F.greatest(x, F.lit(1e-300))) - mu, F.lit(2.0)) / (2 * sd * sd)) / (x * sd * math.sqrt(_TAU))), None


# Losses of (prediction, truth).
def squared_loss(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def absolute_loss(p: Column, y: Column) -> Column:
    return F.abs(p - y)


def huber_loss(p: Column, y: Column, c: float = 1.0) -> Column:
    d = F.abs(p - y)
    return F.when(d <= c, d * d * 0.5).otherwise(c * (d - c / 2))


def epsilon_insensitive_loss(p: Column, y: Column, eps: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.abs(p - y) - eps)


def hinge_loss(p: Column, y: Column) -> Column:
    """``y`` is -1 or 1."""
    return F.greatest(F.lit(0.0), 1 - y * p)


def logistic_loss(p: Column, y: Column) -> Column:
    return F.log1p(F.exp(-y * p))


def softmax_loss(scores: Column, label: Column) -> Column:
    """Logarithmic loss of an array of class scores against a class number."""
    top = F.array_max(scores)
    total = F.log(F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return total + top - F.element_at(scores, label.cast("int") + 1)


# Activations.
def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(x))


def softsign(x: Column) -> Column:
    return x / (1 + F.abs(x))


def logit(x: Column) -> Column:
    return F.log(x / (1 - x))


# Decay rates of a step t.
def no_decay(t: Column, start: float) -> Column:
    return F.lit(start) + 0 * t


def linear_decay(t: Column, start: float, end: float, most: float) -> Column:
    return start - (start - end) * F.least(t / most, F.lit(1.0))


def exponential_decay(t: Column, start: float, end: float, most: float) -> Column:
    return start * F.pow(F.lit(end / start), t / most)


def inverse_decay(t: Column, start: float, tau: float = 1.0, alpha: float = 1.0) -> Column:
    return start / F.pow(1 + t / tau, F.lit(alpha))


def power_decay(t: Column, start: float, tau: float = 10.0, alpha: float = 0.5) -> Column:
    return start * F.pow(tau / (tau + t), F.lit(alpha))


# Extra trigonometry.
def asinh(x: Column) -> Column:
    return F.log(x + F.sqrt(x * x + 1))


def atanh(x: Column) -> Column:
    return F.log((1 + x) / (1 - x)) / 2


def sec(x: Column) -> Column:
    return 1 / F.cos(x)


def csc(x: Column) -> Column:
    return 1 / F.sin(x)


def cot(x: Column) -> Column:
    return F.cos(x) / F.sin(x)
