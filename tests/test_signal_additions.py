"""Spectra over segments, planar filters, splines, hulls and further distributions against plain numpy or counting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksci.functions import distributions as D
from sparksci.functions import vectors as V
from sparksci.functions import windows
from sparksci.operators import graph as G
from sparksci.operators import images as M
from sparksci.operators import interpolate as P
from sparksci.operators import series as S
from sparksci.operators import spatial as X


def values(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    a = np.sin(np.arange(n) * 0.7) + rng.normal(size=n)
    b = np.roll(a, 3) + 0.1 * rng.normal(size=n)
    return a, b, spark.createDataFrame([("s", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "g string, t long, x double, y double")


def test_cross_density_and_coherence_equal_averaged_transforms(spark):
    a, b, df = values(spark)
    taper = windows.samples("hann", 64, periodic=False)
    z, p, q = [], [], []
    for at in range(0, 300 - 63, 32):
        fa, fb = (np.fft.rfft((v[at : at + 64] - v[at : at + 64].mean()) * taper) for v in (a, b))
        z.append(np.conj(fa) * fb), p.append(abs(fa) ** 2), q.append(abs(fb) ** 2)
    scale = np.full(33, 2.0)
    scale[[0, -1]] = 1.0
    scale /= (taper**2).sum()
    z, p, q = (np.mean(v, axis=0) * scale for v in (z, p, q))
    got = S.csd(df, "x", "y", "t", "g", nperseg=64).orderBy("bin").collect()
    assert [r["re"] + 1j * r["im"] for r in got] == pytest.approx(list(z)) and [r["pxx"] for r in got] == pytest.approx(list(p))
    same = [r["coherence"] for r in S.coherence(df, "x", "y", "t", "g", nperseg=64).orderBy("bin").collect()]
    assert same == pytest.approx(list(abs(z) ** 2 / (p * q)))
    own = {r["bin"]: r["psd"] for r in S.welch(df, "x", "t", "g", nperseg=64).collect()}
    assert [own[k] for k in range(33)] == pytest.approx(list(p))


def test_periodogram_equals_the_transform(spark):
    a, _, df = values(spark, 101)
    full = np.abs(np.fft.rfft(a - a.mean())) ** 2 / 101 * 2
    got = S.leading_bins(df, "x", "t", "g", bins=200).orderBy("bin").collect()
    assert [r["psd"] for r in got[1:]] == pytest.approx(list(full[1:])) and abs(got[0]["psd"]) < 1e-9
    assert S.leading_bins(df.where("t < 0"), "x", "t").count() == 0


def test_inverse_transform_gives_the_series_back(spark):
    a, _, df = values(spark, 200)
    got = {r["i"]: r["value"] for r in S.istft(S.stft(df, "x", "t", "g", 32), "g", 32).collect()}
    assert [got[i] for i in range(1, 180)] == pytest.approx(list(a[1:180]))


def image(spark, h=9, w=7, seed=2):
    v = np.random.default_rng(seed).normal(size=(h, w)).round(3)
    return v, spark.createDataFrame([("i", y, x, float(v[y, x])) for y in range(h) for x in range(w)], "img string, y int, x int, v double")


def read(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_planar_filters_equal_loops(spark):
    v, df = image(spark)
    kernel = np.array([[1.0, 2, 0], [0.5, -1, 3], [0, 4, -2]])
    wide = np.pad(v, 1)
    near = np.array([[wide[y : y + 3, x : x + 3] for x in range(7)] for y in range(9)])
    assert read(M.correlate2d(df, kernel.tolist()), v.shape) == pytest.approx((near * kernel).sum(axis=(2, 3)))
    assert read(M.convolve2d(df, kernel.tolist()), v.shape) == pytest.approx((near * kernel[::-1, ::-1]).sum(axis=(2, 3)))
    inner = [[v[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2] for x in range(7)] for y in range(9)]  # squares that shrink at the borders
    assert read(M.medfilt2d(df), v.shape) == pytest.approx(np.array([[np.sort(q.ravel())[q.size // 2] for q in row] for row in inner]))
    mean, var = (np.array([[f(q) for q in row] for row in inner]) for f in (np.mean, np.var))
    noise = max(var.min(), 1e-10)
    assert read(M.wiener2d(df), v.shape) == pytest.approx(mean + np.where(var > noise, (var - noise) / np.maximum(var, 1e-12), 0) * (v - mean))
    assert read(M.wiener2d(df, 3, 2.0), v.shape) == pytest.approx(mean + np.where(var > 2, (var - 2) / np.maximum(var, 1e-12), 0) * (v - mean))
    with pytest.raises(ValueError):
        M.medfilt2d(df, 4)


@pytest.mark.parametrize("bc", ["natural", "clamped"])
def test_cubic_splines_are_smooth_and_meet_their_ends(spark, bc):
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.uniform(0.2, 2, 12))
    y = rng.normal(size=12)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)] + [("b", 1.0, 2.0), ("c", None, 1.0)], "g string, x double, y double")
    got = [r for r in P.cubic_spline_coefficients(df, "x", "y", "g", bc).orderBy("segment").collect() if r["g"] == "a"]
    assert len(got) == 11
    for r, s, h in zip(got, got[1:], np.diff(x), strict=False):
        assert r["a"] + r["b"] * h + r["c"] * h**2 + r["d"] * h**3 == pytest.approx(s["a"])
        assert r["b"] + 2 * r["c"] * h + 3 * r["d"] * h**2 == pytest.approx(s["b"]) and r["c"] + 3 * r["d"] * h == pytest.approx(s["c"])
    last, h = got[-1], x[-1] - x[-2]
    assert last["a"] + last["b"] * h + last["c"] * h**2 + last["d"] * h**3 == pytest.approx(y[-1])
    ends = (got[0]["b"], last["b"] + 2 * last["c"] * h + 3 * last["d"] * h**2) if bc == "clamped" else (got[0]["c"], last["c"] + 3 * last["d"] * h)
    assert ends == pytest.approx((0.0, 0.0), abs=1e-9)


def test_points_inside_hulls(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([("g", i, [rng.random() * 4, rng.random() * 4]) for i in range(60)] + [("h", 0, [0.0, 0.0]), ("h", 1, [1.0, 1.0])], "g string, id long, v array<double>")
    asked = spark.createDataFrame([("g", 1, [2.0, 2.0]), ("g", 2, [9.0, 2.0]), ("h", 3, [0.5, 0.5]), ("x", 4, [0.0, 0.0])], "g string, id long, v array<double>")
    got = {r["id"]: r["inside"] for r in X.hull_contains(X.convex_hull(points, "g"), asked, "g").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
    own = X.hull_contains(X.convex_hull(points.where("g = 'g'"), "g"), points.where("g = 'g'"), "g")
    assert own.where("NOT inside").count() == 0


def test_neighbours_leave_out_rows_without_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (None, [5.0, 5.0]), (4, [None, 1.0]), (5, [3.0, 0.0])], "id long, v array<double>")
    got = [(r["query_id"], r["id"]) for r in X.knn(df, df.where("id = 1 OR id = 2"), 2).orderBy("rank").collect()]
    assert got == [(1, 1), (1, 3)]


def test_euler_angles_come_back(spark):
    df = spark.createDataFrame([(0.3, -0.9, 2.5), (-2.0, 1.2, -0.4), (0.0, 0.0, 0.0)], "a double, b double, c double")
    for order in ("XYZ", "ZYX"):
        for r in df.select("a", "b", "c", V.quat_to_euler(V.quat_from_euler(order, F.col("a"), F.col("b"), F.col("c")), order).alias("e")).collect():
            assert (r["e"]["a"], r["e"]["b"], r["e"]["c"]) == pytest.approx((r["a"], r["b"], r["c"]))


def test_strong_connection(spark):
    ring = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    line = ring.where("dst <> 0")
    assert G.is_strongly_connected(ring, G.nodes_of(ring)) and not G.is_strongly_connected(line, G.nodes_of(line))


def test_further_distributions(spark):
    k = spark.range(0, 40).select(F.col("id").cast("double").alias("k"))
    for dist, pmf in (
        (D.negative_binomial(3, 0.4), lambda n: math.comb(n + 2, n) * 0.4**3 * 0.6**n),
        (D.hypergeometric(50, 12, 10), lambda n: math.comb(12, n) * math.comb(38, 10 - n) / math.comb(50, 10) if n <= 10 else 0.0),
    ):
        rows = k.select("k", dist.pdf(F.col("k")).alias("p"), dist.cdf(F.col("k")).alias("c")).orderBy("k").collect()
        want = [pmf(n) for n in range(40)]
        assert [r["p"] for r in rows] == pytest.approx(want, abs=1e-9) and [r["c"] for r in rows] == pytest.approx(list(np.cumsum(want)), abs=1e-8)
        assert dist.mean == pytest.approx(sum(n * pmf(n) for n in range(400)), rel=1e-6)
    x = np.linspace(1e-3, 1.999, 4001)
    grid = spark.createDataFrame([(float(v),) for v in x], "x double")
    for dist in (D.truncated_normal(0.0, 2.0, 0.5, 1.5), D.inverse_gamma(3.0, 2.0)):
        rows = grid.select("x", dist.pdf(F.col("x")).alias("p"), dist.cdf(F.col("x")).alias("c"), dist.quantile(dist.cdf(F.col("x"))).alias("q")).orderBy("x").collect()
        p, c = (np.array([r[n] for r in rows]) for n in "pc")
        area = np.concatenate([[0.0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(x))])
        assert c - c[0] == pytest.approx(area, abs=1e-5)
        assert [r["q"] for r in rows[400::400]] == pytest.approx([r["x"] for r in rows[400::400]], rel=1e-4)


def test_interpolation_is_linear_in_a_group(spark):
    """One group of 20,000 knots and queries: frames grow row by row, so this takes a moment, not minutes."""
    knots = spark.range(20_000).select((F.col("id") * 2.0).alias("x"), (F.col("id") * 6.0).alias("y"))
    asked = spark.range(20_000).select((F.col("id") * 2.0 + 1).alias("q"))
    out = P.interp1d(knots, asked, "x", "y", "q")
    assert out.where("abs(value - 3 * q) > 1e-6").count() == 0 and out.count() == 20_000
