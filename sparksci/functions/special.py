"""Special functions for small results, vectorised in numpy and usable as Arrow UDFs.

They run on aggregated rows (a p-value for each group), never on the raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def gammainc(a, x):
    """Regularised lower incomplete gamma P(a, x): series for x < a + 1, continued fraction beyond."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    low, high = ok & (x < a + 1), ok & (x >= a + 1)
    if low.any():
        p, q = a[low], x[low]
        term = total = 1 / p
        n = p.copy()
        for _ in range(1000):
            n = n + 1
            term = term * q / n
            total = total + term
            if np.all(np.abs(term) <= np.abs(total) * 1e-16):
                break
        with np.errstate(divide="ignore"):
            out[low] = np.where(q > 0, total * np.exp(-q + p * np.log(np.where(q > 0, q, 1)) - _lgamma(p)), 0.0)
    if high.any():
        p, q = a[high], x[high]
        tiny = 1e-300
        b = q + 1 - p
        c, d = np.full(p.shape, 1 / tiny), 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - p)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out[high] = 1 - np.exp(-q + p * np.log(q) - _lgamma(p)) * h
    return out


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones(p.shape), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 1000):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = d * c
            h = h * change
        if np.all(np.abs(change - 1) < 1e-15):
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z))
        out = np.where(z <= 0, 0.0, front * h / p)
    return np.where(swap, 1 - out, out)


def normal_sf(x):
    return 0.5 * _erfc(np.asarray(x, float) / math.sqrt(2))


def normal_ppf(p):
    """Inverse normal by bisection-safe Newton steps from a logistic start."""
    p = np.asarray(p, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.log(p / (1 - p)) / 1.702
        for _ in range(60):
            density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            step = (1 - normal_sf(x) - p) / np.maximum(density, 1e-300)
            x = x - np.clip(step, -1, 1)
            if np.all((np.abs(step) < 1e-15) | ~np.isfinite(step)):
                break
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, x))


def t_two_sided(t, df):
    t, df = np.asarray(t, float), np.asarray(df, float)
    return np.where(np.isinf(t), 0.0, betainc(df / 2, 0.5, df / (df + np.where(np.isinf(t), 0, t) ** 2)))


def chi2_sf(x, df):
    return 1 - gammainc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def f_sf(x, d1, d2):
    x = np.asarray(x, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.where(np.isinf(x), 0, x))) * ~np.isinf(x)


def digamma(x: float) -> float:
    """For positive arguments: recurrence up, then the asymptotic series."""
    total = 0.0
    while x < 10:
        total -= 1 / x
        x += 1
    inv = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))


def elementwise(fn):
    """A numpy function of arrays as a function of columns; null and NaN give null."""

    @F.pandas_udf("double")
    def one(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(float) for c in columns]
        bad = np.any([np.isnan(v) for v in values], axis=0)
        with np.errstate(all="ignore"):
            out = fn(*(np.where(bad, 1.0, v) for v in values))
        return pd.Series(np.where(bad, np.nan, out))

    return lambda *c: F.nanvl(one(*c), F.lit(None).cast("double"))


def t_p_value(t: Column, df: Column) -> Column:
    return elementwise(t_two_sided)(t, df.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    return elementwise(chi2_sf)(x, df.cast("double"))


def f_p_value(x: Column, d1: Column, d2: Column) -> Column:
    return elementwise(f_sf)(x, d1.cast("double"), d2.cast("double"))


def normal_p_value(z: Column) -> Column:
    return elementwise(lambda v: 2 * normal_sf(np.abs(v)))(z)


def normal_quantile(p: Column) -> Column:
    return elementwise(normal_ppf)(p)
