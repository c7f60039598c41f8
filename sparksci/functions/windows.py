"""Signal windows: as array columns for queries and as arrays for tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The cosine terms of each window.
TERMS = {"rectangular": (1.0,), "hann": (0.5, 0.5), "hamming": (0.54, 0.46), "blackman": (0.42, 0.5, 0.08)}


def samples(name: str, n: int, periodic: bool = True) -> np.ndarray:
    if n == 1:
        return np.ones(1)
    at = 2 * np.pi * np.arange(n) / (n if periodic else n - 1)
    return sum((-1) ** k * a * np.cos(k * at) for k, a in enumerate(TERMS[name])) * np.ones(n)


def window(name: str, n: int, periodic: bool = True) -> Column:
    """The window as an array column; periodic by default."""
    if n < 1:
        raise ValueError("a window has one sample at least")
    if n == 1:
        return F.array(F.lit(1.0))
    turn = 2 * math.pi / (n if periodic else n - 1)

    def one(i: Column) -> Column:
        total = F.lit(TERMS[name][0])
        for k, a in enumerate(TERMS[name][1:], 1):
            total = total + (-1) ** k * a * F.cos(i * (k * turn))
        return total

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def weight(name: str, i: Column, n: Column, periodic: bool = False) -> Column:
    """The window's value at place i of n, for windows whose length is a column; symmetric by default."""
    turn = 2 * math.pi * i / F.greatest(n if periodic else n - 1, F.lit(1))
    total = F.lit(TERMS[name][0])
    for k, a in enumerate(TERMS[name][1:], 1):
        total = total + (-1) ** k * a * F.cos(turn * k)
    return F.when(n > 1, total).otherwise(1.0)


def _bessel_i0(x: Column) -> Column:
    """Power series in (x/2)**2, enough terms for double precision up to x = 30."""
    quarter = x * x / 4
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, k: F.struct((acc["sum"] + acc["term"] * quarter / (k * k)).alias("sum"), (acc["term"] * quarter / (k * k)).alias("term")),
        lambda acc: acc["sum"],
    )


def kaiser(n: int, beta: float) -> Column:
    """Symmetric Kaiser window."""
    if n == 1:
        return F.array(F.lit(1.0))
    half = (n - 1) / 2
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: _bessel_i0(beta * F.sqrt(F.greatest(1 - F.pow((i - half) / half, 2), F.lit(0.0)))) / _bessel_i0(F.lit(float(beta))),
    )
