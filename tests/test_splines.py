"""Splines by cyclic reduction against dense systems."""

import numpy as np
import pytest

from sparksci.operators import interpolate, splines


def dense(x, y, bc, slopes=(0.0, 0.0)):
    """Coefficients of all segments from one system of their conditions."""
    n = len(x) - 1
    h = np.diff(x)
    rows, right = [], []

    def add(parts, value):
        row = np.zeros(4 * n)
        for k, part in parts:
            row[4 * k : 4 * k + 4] += part
        rows.append(row)
        right.append(value)

    at = lambda t: np.array([1, t, t * t, t**3])
    slope = lambda t: np.array([0, 1, 2 * t, 3 * t * t])
    bend = lambda t: np.array([0, 0, 2, 6 * t])
    for k in range(n):
        add([(k, at(0))], y[k])
        add([(k, at(h[k]))], y[k + 1])
    for k in range(n - 1):
        add([(k, slope(h[k])), (k + 1, -slope(0))], 0)
        add([(k, bend(h[k])), (k + 1, -bend(0))], 0)
    third = np.array([0, 0, 0, 6.0])
    if bc == "natural" or n == 1 and bc != "clamped":
        add([(0, bend(0))], 0)
        add([(n - 1, bend(h[-1]))], 0)
    elif bc == "clamped":
        add([(0, slope(0))], slopes[0])
        add([(n - 1, slope(h[-1]))], slopes[1])
    else:
        add([(0, third), (1, -third)], 0)
        add([(n - 2, third), (n - 1, -third)], 0)
        if n == 2:
            add([(0, third)], 0)
    return np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0].reshape(n, 4)


@pytest.mark.parametrize("bc", splines.ENDS)
def test_coefficients_of_short_and_long_groups(spark, bc):
    rng = np.random.default_rng(2)
    groups = {None: 41, "a": 2, "b": 3, "c": 4, "d": 5, "e": 18, "one": 1}
    knots = {g: (np.cumsum(rng.uniform(0.2, 2, n)), rng.normal(size=n)) for g, n in groups.items()}
    rows = [(g, float(p), float(q)) for g, (x, y) in knots.items() for p, q in zip(x, y)] + [("a", None, 1.0), ("a", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "i string, x double, n double")  # names that the operator uses itself
    slopes = (0.5, -1.5)
    got = splines.cubic_spline_coefficients(df, "x", "n", "i", bc, slopes, direct=4).collect()
    assert len(got) == sum(n - 1 for n in groups.values())
    for g, (x, y) in knots.items():
        mine = sorted((r for r in got if r["i"] == g), key=lambda r: r["segment"])
        if len(x) > 1:
            assert np.allclose([[r[c] for c in "abcd"] for r in mine], dense(x, y, bc, slopes), atol=1e-7)
            assert np.allclose([r["x0"] for r in mine], x[:-1])


def test_equal_steps_and_drawn_curves(spark):
    """A cubic goes through its knots: not-a-knot gives it back, equal steps and repeated knots included."""
    cubic = lambda t: 1 - 2 * t + 0.5 * t**2 + 0.25 * t**3
    df = spark.createDataFrame([(float(t), cubic(t)) for t in range(-3, 9)] + [(2.0, 99.0)], "x double, y double")
    asked = spark.createDataFrame([(0.25 * k,) for k in range(-14, 34)], "q double")
    drawn = interpolate.hermite(splines.spline_slopes(df, "x", "y", direct=3), asked, "x", "y", "slope", "q")
    rows = drawn.collect()
    assert len(rows) == 48 and all(r["value"] == pytest.approx(cubic(r["q"])) for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "g int, x double, y double")
    assert splines.cubic_spline_coefficients(none, "x", "y", "g").count() == 0
    with pytest.raises(ValueError):
        splines.cubic_spline_coefficients(none, "x", "y", "g", "periodic")
