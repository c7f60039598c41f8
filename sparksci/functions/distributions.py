"""Distributions as column expressions: pdf, cdf, sf, quantile.

``Distribution`` objects hold validated parameters; their methods take and return
columns, so densities and tails stay inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparksci.functions import special


@dataclass(frozen=True)
class Distribution:
    name: str
    pdf: Callable[[Column], Column]
    cdf: Callable[[Column], Column]
    quantile: Callable[[Column], Column]
    mean: float
    variance: float

    def sf(self, x: Column) -> Column:
        return 1 - self.cdf(x)

    def log_pdf(self, x: Column) -> Column:
        return F.log(self.pdf(x))

    def isf(self, p: Column) -> Column:
        return self.quantile(1 - p)


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0 or not math.isfinite(v):
            raise ValueError(f"{name} must be positive and finite")


def _inside(x: Column, low: Column | float, value: Column) -> Column:
    return F.when(x >= low, value).otherwise(0.0)


def uniform(a: float = 0.0, b: float = 1.0) -> Distribution:
    _positive(width=b - a)
    return Distribution(
        "uniform",
        lambda x: F.when((x >= a) & (x <= b), 1 / (b - a)).otherwise(0.0),
        lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a))),
        lambda p: a + p * (b - a),
        (a + b) / 2,
        (b - a) ** 2 / 12,
    )


def exponential(rate: float = 1.0) -> Distribution:
    _positive(rate=rate)
    return Distribution(
        "exponential", lambda x: _inside(x, 0, rate * F.exp(-rate * x)), lambda x: _inside(x, 0, 1 - F.exp(-rate * x)), lambda p: -F.log1p(-p) / rate, 1 / rate, 1 / rate**2
    )


def laplace(loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    z = lambda x: (x - loc) / scale
    return Distribution(
        "laplace",
        lambda x: F.exp(-F.abs(z(x))) / (2 * scale),
        lambda x: F.when(z(x) < 0, F.exp(z(x)) / 2).otherwise(1 - F.exp(-z(x)) / 2),
        lambda p: loc + scale * F.when(p < 0.5, F.log(2 * p)).otherwise(-F.log(2 - 2 * p)),
        loc,
        2 * scale**2,
    )


def logistic(loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    z = lambda x: (x - loc) / scale
    cdf = lambda x: 1 / (1 + F.exp(-z(x)))
    return Distribution("logistic", lambda x: cdf(x) * (1 - cdf(x)) / scale, cdf, lambda p: loc + scale * F.log(p / (1 - p)), loc, (math.pi * scale) ** 2 / 3)


def cauchy(loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    z = lambda x: (x - loc) / scale
    return Distribution(
        "cauchy", lambda x: 1 / (math.pi * scale * (1 + z(x) ** 2)), lambda x: F.atan(z(x)) / math.pi + 0.5, lambda p: loc + scale * F.tan(math.pi * (p - 0.5)), math.nan, math.nan
    )


def weibull(shape: float, scale: float = 1.0) -> Distribution:
    _positive(shape=shape, scale=scale)
    g = lambda k: math.gamma(1 + k / shape)
    return Distribution(
        "weibull",
        lambda x: _inside(x, 0, shape / scale * F.pow(x / scale, shape - 1) * F.exp(-F.pow(x / scale, F.lit(shape)))),
        lambda x: _inside(x, 0, 1 - F.exp(-F.pow(x / scale, F.lit(shape)))),
        lambda p: scale * F.pow(-F.log1p(-p), F.lit(1 / shape)),
        scale * g(1),
        scale**2 * (g(2) - g(1) ** 2),
    )


def pareto(shape: float, scale: float = 1.0) -> Distribution:
    _positive(shape=shape, scale=scale)
    return Distribution(
        "pareto",
        lambda x: _inside(x, scale, shape * scale**shape / F.pow(x, F.lit(shape + 1))),
        lambda x: _inside(x, scale, 1 - F.pow(scale / x, F.lit(shape))),
        lambda p: scale * F.pow(1 - p, F.lit(-1 / shape)),
        shape * scale / (shape - 1) if shape > 1 else math.inf,
        scale**2 * shape / ((shape - 1) ** 2 * (shape - 2)) if shape > 2 else math.inf,
    )


def gumbel(loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    z = lambda x: (x - loc) / scale
    euler = 0.5772156649015329
    return Distribution(
        "gumbel", lambda x: F.exp(-z(x) - F.exp(-z(x))) / scale, lambda x: F.exp(-F.exp(-z(x))), lambda p: loc - scale * F.log(-F.log(p)), loc + scale * euler, (math.pi * scale) ** 2 / 6
    )


def rayleigh(scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    return Distribution(
        "rayleigh",
        lambda x: _inside(x, 0, x / scale**2 * F.exp(-(x**2) / (2 * scale**2))),
        lambda x: _inside(x, 0, 1 - F.exp(-(x**2) / (2 * scale**2))),
        lambda p: scale * F.sqrt(-2 * F.log1p(-p)),
        scale * math.sqrt(math.pi / 2),
        (4 - math.pi) / 2 * scale**2,
    )


def triangular(low: float, mode: float, high: float) -> Distribution:
    _positive(width=high - low)
    if not low <= mode <= high:
        raise ValueError("low <= mode <= high")
    w, a, b = high - low, max(mode - low, 1e-300), max(high - mode, 1e-300)
    return Distribution(
        "triangular",
        lambda x: F.when((x < low) | (x > high), 0.0).when(x < mode, 2 * (x - low) / (w * a)).otherwise(2 * (high - x) / (w * b)),
        lambda x: F.when(x <= low, 0.0).when(x >= high, 1.0).when(x <= mode, (x - low) ** 2 / (w * a)).otherwise(1 - (high - x) ** 2 / (w * b)),
        lambda p: F.when(p < (mode - low) / w, low + F.sqrt(p * w * a)).otherwise(high - F.sqrt((1 - p) * w * b)),
        (low + mode + high) / 3,
        (low**2 + mode**2 + high**2 - low * mode - low * high - mode * high) / 18,
    )


def geometric(p: float) -> Distribution:
    """Trials until the first success, from 1."""
    if not 0 < p <= 1:
        raise ValueError("p lies in (0, 1]")
    q = 1 - p
    return Distribution(
        "geometric",
        lambda k: F.when((k >= 1) & (k == F.floor(k)), p * F.pow(F.lit(q), k - 1)).otherwise(0.0),
        lambda k: _inside(k, 1, 1 - F.pow(F.lit(q), F.floor(k))),
        lambda u: F.greatest(F.lit(1.0), F.ceil(F.log1p(-u) / math.log(q)).cast("double")) if q > 0 else F.lit(1.0),
        1 / p,
        q / p**2,
    )


def bernoulli(p: float) -> Distribution:
    if not 0 <= p <= 1:
        raise ValueError("p lies in [0, 1]")
    return Distribution(
        "bernoulli",
        lambda k: F.when(k == 1, p).when(k == 0, 1 - p).otherwise(0.0),
        lambda k: F.when(k < 0, 0.0).when(k < 1, 1 - p).otherwise(1.0),
        lambda u: F.when(u <= 1 - p, 0.0).otherwise(1.0),
        p,
        p * (1 - p),
    )


def discrete_uniform(low: int, high: int) -> Distribution:
    n = high - low + 1
    _positive(size=n)
    return Distribution(
        "discrete_uniform",
        lambda k: F.when((k >= low) & (k <= high) & (k == F.floor(k)), 1 / n).otherwise(0.0),
        lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.floor(k) - low + 1) / n)),
        lambda u: F.greatest(F.lit(float(low)), low - 1 + F.ceil(u * n)).cast("double"),
        (low + high) / 2,
        (n**2 - 1) / 12,
    )


# --- distributions whose cdf is a special function: densities are expressions, tails Arrow helpers -----------


def _special(fn) -> Callable[[Column], Column]:
    return lambda x: special.elementwise(fn)(x)


def _by_bisection(cdf, low: float, high: float):
    """Quantiles of a continuous distribution by halving an interval that holds them, vectorised."""

    def quantile(p):
        a, b = np.full(len(p), low), np.full(len(p), high)
        for _ in range(200):
            mid = (a + b) / 2
            below = cdf(mid) < p
            a, b = np.where(below, mid, a), np.where(below, b, mid)
        return (a + b) / 2

    return quantile


def normal(loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale)
    return Distribution(
        "normal",
        lambda x: F.exp(-((x - loc) ** 2) / (2 * scale**2)) / (scale * math.sqrt(2 * math.pi)),
        _special(lambda x: 1 - special.normal_sf((x - loc) / scale)),
        _special(lambda p: loc + scale * special.normal_ppf(p)),
        loc,
        scale**2,
    )


def lognormal(mu: float = 0.0, sigma: float = 1.0) -> Distribution:
    _positive(sigma=sigma)
    return Distribution(
        "lognormal",
        lambda x: F.when(x > 0, F.exp(-((F.log(x) - mu) ** 2) / (2 * sigma**2)) / (x * (sigma * math.sqrt(2 * math.pi)))).otherwise(0.0),
        _special(lambda x: np.where(x > 0, 1 - special.normal_sf((np.log(np.where(x > 0, x, 1)) - mu) / sigma), 0.0)),
        _special(lambda p: np.exp(mu + sigma * special.normal_ppf(p))),
        math.exp(mu + sigma**2 / 2),
        (math.exp(sigma**2) - 1) * math.exp(2 * mu + sigma**2),
    )


def gamma(shape: float, scale: float = 1.0) -> Distribution:
    _positive(shape=shape, scale=scale)
    cdf = lambda x: special.gammainc(shape, np.maximum(x, 0) / scale)
    top = scale * (shape + 40 * math.sqrt(shape) + 800)
    log_norm = math.lgamma(shape) + shape * math.log(scale)
    return Distribution(
        "gamma",
        lambda x: F.when(x > 0, F.exp((shape - 1) * F.log(x) - x / scale - log_norm)).otherwise(0.0),
        _special(cdf),
        _special(_by_bisection(cdf, 0.0, top)),
        shape * scale,
        shape * scale**2,
    )


def chi2(df: float) -> Distribution:
    return replace(gamma(df / 2, 2.0), name="chi2")


def beta(a: float, b: float) -> Distribution:
    _positive(a=a, b=b)
    cdf = lambda x: special.betainc(a, b, np.clip(x, 0, 1))
    log_norm = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return Distribution(
        "beta",
        lambda x: F.when((x > 0) & (x < 1), F.exp((a - 1) * F.log(x) + (b - 1) * F.log1p(-x) - log_norm)).otherwise(0.0),
        _special(cdf),
        _special(_by_bisection(cdf, 0.0, 1.0)),
        a / (a + b),
        a * b / ((a + b) ** 2 * (a + b + 1)),
    )


def student_t(df: float) -> Distribution:
    _positive(df=df)
    cdf = lambda x: np.where(x > 0, 1 - special.t_two_sided(x, df) / 2, special.t_two_sided(x, df) / 2)
    log_norm = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return Distribution(
        "student_t",
        lambda x: F.exp(log_norm - (df + 1) / 2 * F.log1p(x**2 / df)),
        _special(cdf),
        _special(_by_bisection(cdf, -1e8, 1e8)),
        0.0 if df > 1 else math.nan,
        df / (df - 2) if df > 2 else math.inf,
    )


def f_distribution(d1: float, d2: float) -> Distribution:
    _positive(d1=d1, d2=d2)
    cdf = lambda x: 1 - special.f_sf(np.maximum(x, 0), d1, d2)
    log_norm = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2) + d1 / 2 * math.log(d1 / d2)
    return Distribution(
        "f",
        lambda x: F.when(x > 0, F.exp(log_norm + (d1 / 2 - 1) * F.log(x) - (d1 + d2) / 2 * F.log1p(x * (d1 / d2)))).otherwise(0.0),
        _special(cdf),
        _special(_by_bisection(cdf, 0.0, 1e8)),
        d2 / (d2 - 2) if d2 > 2 else math.inf,
        2 * d2**2 * (d1 + d2 - 2) / (d1 * (d2 - 2) ** 2 * (d2 - 4)) if d2 > 4 else math.inf,
    )


def _counts(name: str, log_pmf, cdf, top: float, mean: float, variance: float) -> Distribution:
    """A distribution of whole numbers from its log-pmf and cdf."""
    whole = lambda k: (k >= 0) & (k == np.floor(k))

    def quantile(p):
        x = np.ceil(_by_bisection(lambda v: cdf(np.floor(v)), -1.0, top)(p) - 1e-9)
        return np.maximum(x, 0)

    return Distribution(name, _special(lambda k: np.where(whole(k), np.exp(log_pmf(np.where(whole(k), k, 0))), 0.0)), _special(lambda k: np.where(k < 0, 0.0, cdf(np.floor(np.maximum(k, 0))))), _special(quantile), mean, variance)


def poisson(rate: float) -> Distribution:
    _positive(rate=rate)
    return _counts(
        "poisson", lambda k: k * math.log(rate) - rate - special._lgamma(k + 1), lambda k: np.where(k < 0, 0.0, 1 - special.gammainc(np.maximum(k, 0) + 1, rate)), rate + 40 * math.sqrt(rate) + 100, rate, rate
    )


def binomial(n: int, p: float) -> Distribution:
    if n < 0 or not 0 < p < 1:
        raise ValueError("n is not negative and p lies in (0, 1)")
    choose = lambda k: special._lgamma(n + 1) - special._lgamma(k + 1) - special._lgamma(np.maximum(n - k, 0) + 1)
    log_pmf = lambda k: np.where(k <= n, choose(k) + k * math.log(p) + (n - k) * math.log1p(-p), -np.inf)
    cdf = lambda k: np.where(k < 0, 0.0, np.where(k >= n, 1.0, special.betainc(np.maximum(n - k, 1e-9), np.maximum(k, 0) + 1, 1 - p)))
    return _counts("binomial", log_pmf, cdf, float(n), n * p, n * p * (1 - p))


def inverse_gamma(shape: float, scale: float = 1.0) -> Distribution:
    _positive(shape=shape, scale=scale)
    cdf = lambda x: np.where(x > 0, 1 - special.gammainc(shape, scale / np.where(x > 0, x, 1.0)), 0.0)
    log_norm = shape * math.log(scale) - math.lgamma(shape)
    return Distribution(
        "inverse_gamma",
        lambda x: F.when(x > 0, F.exp(log_norm - (shape + 1) * F.log(x) - scale / x)).otherwise(0.0),
        _special(cdf),
        _special(_by_bisection(cdf, 0.0, scale * 1e6)),
        scale / (shape - 1) if shape > 1 else math.inf,
        scale**2 / ((shape - 1) ** 2 * (shape - 2)) if shape > 2 else math.inf,
    )


def truncated_normal(low: float, high: float, loc: float = 0.0, scale: float = 1.0) -> Distribution:
    _positive(scale=scale, width=high - low)
    below = lambda x: 1 - special.normal_sf((np.asarray(x, float) - loc) / scale)
    first, mass = float(below(low)), float(below(high) - below(low))
    a, b = (low - loc) / scale, (high - loc) / scale
    dens = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    shift = (dens(a) - dens(b)) / mass
    return Distribution(
        "truncated_normal",
        lambda x: F.when((x >= low) & (x <= high), F.exp(-((x - loc) ** 2) / (2 * scale**2)) / (scale * math.sqrt(2 * math.pi) * mass)).otherwise(0.0),
        _special(lambda x: np.clip((below(x) - first) / mass, 0.0, 1.0)),
        _special(lambda p: np.clip(loc + scale * special.normal_ppf(first + p * mass), low, high)),
        loc + scale * shift,
        scale**2 * (1 + (a * dens(a) - b * dens(b)) / mass - shift**2),
    )


def negative_binomial(r: float, p: float) -> Distribution:
    """Failures before the r-th success."""
    _positive(r=r)
    if not 0 < p < 1:
        raise ValueError("p lies in (0, 1)")
    log_pmf = lambda k: special._lgamma(k + r) - special._lgamma(k + 1) - math.lgamma(r) + r * math.log(p) + k * math.log1p(-p)
    cdf = lambda k: np.where(k < 0, 0.0, special.betainc(r, np.maximum(k, 0) + 1, p))
    mean, variance = r * (1 - p) / p, r * (1 - p) / p**2
    return _counts("negative_binomial", log_pmf, cdf, mean + 40 * math.sqrt(variance) + 100, mean, variance)


def hypergeometric(total: int, marked: int, drawn: int) -> Distribution:
    """Marked ones among those drawn without putting back; the probabilities of all counts, at most ``drawn``, are summed once."""
    if not (0 <= marked <= total and 0 <= drawn <= total and total > 0):
        raise ValueError("marked and drawn lie between 0 and total")
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    low, high = max(0, drawn + marked - total), min(drawn, marked)
    logs = np.array([choose(marked, k) + choose(total - marked, drawn - k) - choose(total, drawn) for k in range(low, high + 1)])
    sums = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    at = lambda k: np.clip(np.asarray(k) - low, 0, high - low).astype(int)
    log_pmf = lambda k: np.where((k >= low) & (k <= high), logs[at(k)], -np.inf)
    cdf = lambda k: np.where(k < low, 0.0, np.where(k >= high, 1.0, sums[at(k)]))
    mean = drawn * marked / total
    variance = mean * (1 - marked / total) * (total - drawn) / (total - 1) if total > 1 else 0.0
    return _counts("hypergeometric", log_pmf, cdf, float(high), mean, variance)
