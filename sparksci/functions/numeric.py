"""Numerical methods as folds inside a row: roots, minima, quadrature, differential equations and curves.

The function to work on is a Python callable of columns; it becomes part of the
expression, so millions of rows, each with its own parameters, are solved in one query
without Python workers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n))


def bisect(f: Fn, a: Column, b: Column, steps: int = 60) -> Column:
    """Root of f between a and b; null if the ends do not have opposite signs."""

    def halve(s: Column, _: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        left = f(s["a"]) * f(mid) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(mid).alias("a"), F.when(left, mid).otherwise(s["b"]).alias("b"))

    start = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    return F.when(f(a) * f(b) <= 0, F.aggregate(_steps(steps), start, halve, lambda s: (s["a"] + s["b"]) / 2))


def newton(f: Fn, df: Fn, x0: Column, steps: int = 50) -> Column:
    """Newton's iteration; stays where the derivative vanishes."""
    return F.aggregate(_steps(steps), x0.cast("double"), lambda x, _: x - F.coalesce(F.try_divide(f(x), df(x)), F.lit(0.0)))


def secant(f: Fn, x0: Column, x1: Column, steps: int = 50) -> Column:
    def step(s: Column, _: Column) -> Column:
        move = F.coalesce(F.try_divide(f(s["b"]) * (s["b"] - s["a"]), f(s["b"]) - f(s["a"])), F.lit(0.0))
        return F.struct(s["b"].alias("a"), (s["b"] - move).alias("b"))

    return F.aggregate(_steps(steps), F.struct(x0.cast("double").alias("a"), x1.cast("double").alias("b")), step, lambda s: s["b"])


def fixed_point(g: Fn, x0: Column, steps: int = 100) -> Column:
    return F.aggregate(_steps(steps), x0.cast("double"), lambda x, _: g(x))


def golden(f: Fn, a: Column, b: Column, steps: int = 60) -> Column:
    """Minimum of a unimodal f on [a, b]."""
    ratio = (math.sqrt(5) - 1) / 2

    def shrink(s: Column, _: Column) -> Column:
        c, d = s["b"] - ratio * (s["b"] - s["a"]), s["a"] + ratio * (s["b"] - s["a"])
        lower = f(c) < f(d)
        return F.struct(F.when(lower, s["a"]).otherwise(c).alias("a"), F.when(lower, d).otherwise(s["b"]).alias("b"))

    return F.aggregate(_steps(steps), F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")), shrink, lambda s: (s["a"] + s["b"]) / 2)


def _weighted(f: Fn, a: Column, b: Column, nodes: list[float], weights: list[float]) -> Column:
    pairs = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip(nodes, weights, strict=True)))
    half, mid = (b - a) / 2, (a + b) / 2
    return half * F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"] * f(mid + half * p["x"]))


def fixed_quad(f: Fn, a: Column, b: Column, n: int = 5) -> Column:
    """Gauss-Legendre quadrature of n nodes."""
    return _weighted(f, a, b, *(v.tolist() for v in np.polynomial.legendre.leggauss(n)))


def tanh_sinh(f: Fn, a: Column, b: Column, levels: int = 4) -> Column:
    """Double-exponential quadrature: good with singular ends, which it never touches."""
    h = 0.5**levels
    k = np.arange(-int(3.0 / h), int(3.0 / h) + 1) * h
    x = np.tanh(np.pi / 2 * np.sinh(k))
    w = h * np.pi / 2 * np.cosh(k) / np.cosh(np.pi / 2 * np.sinh(k)) ** 2
    inside = np.abs(x) < 1
    return _weighted(f, a, b, x[inside].tolist(), w[inside].tolist())


def trapezoid(f: Fn, a: Column, b: Column, n: int) -> Column:
    h = (b - a) / n
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0.0), lambda s, k: s + f(a + h * k)) if n > 1 else F.lit(0.0)
    return h * ((f(a) + f(b)) / 2 + inner)


def romberg(f: Fn, a: Column, b: Column, levels: int = 5) -> Column:
    """Richardson extrapolation of trapezoidal sums with 1, 2, 4, ... intervals."""
    rows = [trapezoid(f, a, b, 1 << k) for k in range(levels)]
    for j in range(1, levels):
        rows = [(4**j * fine - coarse) / (4**j - 1) for coarse, fine in zip(rows, rows[1:], strict=False)]
    return rows[0]


def _radical_inverse(i: Column, base: int, digits: int = 40) -> Column:
    start = F.struct(i.cast("long").alias("n"), F.lit(1.0 / base).alias("f"), F.lit(0.0).alias("r"))
    step = lambda s, _: F.struct(F.floor(s["n"] / base).alias("n"), (s["f"] / base).alias("f"), (s["r"] + s["f"] * (s["n"] % base)).alias("r"))
    return F.aggregate(_steps(digits), start, step, lambda s: s["r"])


def halton(i: Column, bases: tuple[int, ...] = (2, 3)) -> Column:
    """Point i of the Halton sequence, one coordinate a base."""
    return F.array(*(_radical_inverse(i, b) for b in bases))


def rk4(f: Callable[[Column, Column], Column], t0: Column, t1: Column, y0: Column, steps: int) -> Column:
    """y(t1) of y' = f(t, y) for an array y, by the classical Runge-Kutta method; f returns an array."""
    h = (t1 - t0) / steps
    plus = lambda y, k, c: F.zip_with(y, k, lambda p, q: p + c * q)

    def step(s: Column, _: Column) -> Column:
        # Each stage is bound once, as the element of a one-element array.
        def bound(value: Column, use: Callable[[Column], Column]) -> Column:
            return F.element_at(F.transform(F.array(value), use), 1)

        t, y = s["t"], s["y"]
        end = lambda k1, k2, k3, k4: F.struct(
            (t + h).alias("t"),
            F.zip_with(F.zip_with(y, F.zip_with(k1, k4, lambda p, q: p + q), lambda p, q: p + h / 6 * q), F.zip_with(k2, k3, lambda p, q: p + q), lambda p, q: p + h / 3 * q).alias("y"),
        )
        return bound(
            f(t, y),
            lambda k1: bound(
                f(t + h / 2, plus(y, k1, h / 2)),
                lambda k2: bound(f(t + h / 2, plus(y, k2, h / 2)), lambda k3: bound(f(t + h, plus(y, k3, h)), lambda k4: end(k1, k2, k3, k4))),
            ),
        )

    start = F.struct(t0.cast("double").alias("t"), F.transform(y0, lambda c: c.cast("double")).alias("y"))
    return F.aggregate(_steps(steps), start, step, lambda s: s["y"])


def verlet(force: Fn, q0: Column, p0: Column, dt: float, steps: int) -> Column:
    """struct<q, p> after so many steps of the velocity Verlet method with unit mass."""

    def step(s: Column, _: Column) -> Column:
        half = s["p"] + dt / 2 * force(s["q"])
        q = s["q"] + dt * half
        return F.struct(q.alias("q"), (half + dt / 2 * force(q)).alias("p"))

    return F.aggregate(_steps(steps), F.struct(q0.cast("double").alias("q"), p0.cast("double").alias("p")), step)


def bezier(points: list[list[float]], t: Column) -> Column:
    """Point of a Bezier curve: Bernstein polynomials of its degree."""
    n = len(points) - 1
    basis = [math.comb(n, k) * F.pow(t, F.lit(k)) * F.pow(1 - t, F.lit(n - k)) for k in range(n + 1)]
    return F.array(*(sum((b * p[d] for b, p in zip(basis, points, strict=True)), F.lit(0.0)) for d in range(len(points[0]))))


def bezier_derivative(points: list[list[float]], t: Column, order: int = 1) -> Column:
    for _ in range(order):
        n = len(points) - 1
        points = [[n * (q - p) for p, q in zip(a, b, strict=True)] for a, b in zip(points, points[1:], strict=False)] or [[0.0] * len(points[0])]
    return bezier(points, t)


def bspline_basis(knots: list[float], degree: int, t: Column) -> list[Column]:
    """Basis values by the two-term recursion; the last non-empty span includes its right end."""
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    row = [F.when((t >= a) & ((t < b) if i != last else (t <= b)), 1.0).otherwise(0.0) if a < b else F.lit(0.0) for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False))]
    for k in range(1, degree + 1):
        part = lambda i, up: (
            ((t - knots[i]) / (knots[i + k] - knots[i]) if up else (knots[i + k + 1] - t) / (knots[i + k + 1] - knots[i + 1]))  # noqa: B023
            if (knots[i + k] > knots[i] if up else knots[i + k + 1] > knots[i + 1])  # noqa: B023
            else F.lit(0.0)
        )
        row = [part(i, True) * row[i] + part(i, False) * row[i + 1] for i in range(len(row) - 1)]
    return row


def bspline(points: list[list[float]], knots: list[float], degree: int, t: Column, weights: list[float] | None = None) -> Column:
    """Point of a B-spline curve, or of a rational one if weights are given."""
    basis = bspline_basis(knots, degree, t)
    if weights:
        basis = [b * w for b, w in zip(basis, weights, strict=True)]
    total = sum(basis, F.lit(0.0)) if weights else F.lit(1.0)
    return F.array(*(sum((b * p[d] for b, p in zip(basis, points, strict=True)), F.lit(0.0)) / total for d in range(len(points[0]))))
