"""Numerical methods, image filters, matrices and mixtures against closed forms and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksci.functions import numeric as N
from sparksci.operators import graph as G
from sparksci.operators import images as M
from sparksci.operators import matrix as X
from sparksci.operators import mixture


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def lit(x):
    return F.lit(float(x))


def test_roots_and_minima(spark):
    f, df = lambda x: x * x - 2, lambda x: 2 * x
    assert value(spark, N.bisect(f, lit(0), lit(2))) == pytest.approx(math.sqrt(2))
    assert value(spark, N.bisect(f, lit(2), lit(3))) is None
    assert value(spark, N.newton(f, df, lit(1))) == pytest.approx(math.sqrt(2))
    assert value(spark, N.secant(f, lit(1), lit(2))) == pytest.approx(math.sqrt(2))
    assert value(spark, N.fixed_point(F.cos, lit(1))) == pytest.approx(0.7390851332, abs=1e-9)
    assert value(spark, N.golden(lambda x: (x - 3) * (x - 3), lit(0), lit(10))) == pytest.approx(3, abs=1e-6)


def test_quadrature(spark):
    for rule in (N.fixed_quad, N.romberg, N.tanh_sinh):
        assert value(spark, rule(F.exp, lit(0), lit(1))) == pytest.approx(math.e - 1, abs=1e-6)
    assert value(spark, N.tanh_sinh(lambda x: 1 / F.sqrt(x), lit(0), lit(1))) == pytest.approx(2, abs=1e-5)
    assert value(spark, N.halton(F.lit(5), (2, 3))) == pytest.approx([0.625, 2 / 3 + 1 / 9])


def test_differential_equations(spark):
    decay = lambda t, y: F.transform(y, lambda c: -c)
    assert value(spark, N.rk4(decay, lit(0), lit(5), F.array(lit(1)), 60))[0] == pytest.approx(math.exp(-5), abs=1e-4)
    s = value(spark, N.verlet(lambda q: -q, lit(1), lit(0), 0.01, 628))
    assert s["q"] == pytest.approx(1, abs=1e-3) and s["q"] ** 2 + s["p"] ** 2 == pytest.approx(1, abs=1e-3)


def test_curves(spark):
    points = [[0.0, 0.0], [1.0, 2.0], [3.0, 0.0]]
    assert value(spark, N.bezier(points, lit(0.5))) == pytest.approx([1.25, 1.0])
    assert value(spark, N.bezier_derivative(points, lit(0))) == pytest.approx([2, 4])
    knots = [0.0, 0, 0, 1, 1, 1]
    assert value(spark, N.bspline(points, knots, 2, lit(0.5))) == pytest.approx([1.25, 1.0])
    assert value(spark, N.bspline(points, knots, 2, lit(1))) == pytest.approx([3, 0])
    arc = N.bspline([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], knots, 2, lit(0.3), [1.0, math.sqrt(0.5), 1.0])
    assert sum(c * c for c in value(spark, arc)) == pytest.approx(1)


def grid(spark, a):
    return spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "img int, y int, x int, v double")


def array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_image_filters(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(7, 8))
    df = grid(spark, a)
    p = np.pad(a, 1, mode="reflect")
    want = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    assert array(M.laplace(df), a.shape) == pytest.approx(want)
    edge = p[:, 2:] - p[:, :-2]
    assert array(M.sobel(df), a.shape) == pytest.approx(edge[:-2] + 2 * edge[1:-1] + edge[2:])
    wide = np.pad(a, 4, mode="reflect")
    k = np.array(M.gaussian_kernel(1.0))
    smooth = sum(k[i] * k[j] * wide[i : i + 7, j : j + 8] for i in range(9) for j in range(9))
    assert array(M.gaussian(df), a.shape) == pytest.approx(smooth)


def test_distances_and_holes(spark):
    a = np.zeros((5, 6))
    a[1, 1] = a[4, 5] = 1
    y, x = np.mgrid[:5, :6]
    near = lambda f: np.minimum(f(abs(y - 1), abs(x - 1)), f(abs(y - 4), abs(x - 5)))
    df = grid(spark, a)
    assert array(M.distance_transform(df), a.shape) == pytest.approx(near(np.hypot))
    assert array(M.distance_transform(df, "cityblock"), a.shape) == pytest.approx(near(np.add))
    assert array(M.distance_transform(df, "chessboard"), a.shape) == pytest.approx(near(np.maximum))
    ring = np.ones((5, 5))
    ring[2, 2] = ring[0, 0] = 0
    filled = ring.copy()
    filled[2, 2] = 1
    assert array(M.binary_fill_holes(grid(spark, ring)), ring.shape).tolist() == filled.tolist()


def test_grid_equations(spark):
    n = 9
    x = np.linspace(0, 1, n)
    exact = np.sin(np.pi * x)[:, None] * np.sin(np.pi * x)
    df = grid(spark, np.zeros((n, n))).withColumn("f", F.lit(2 * math.pi**2) * F.sin(math.pi * F.col("x") / (n - 1)) * F.sin(math.pi * F.col("y") / (n - 1)))
    solved, steps = M.poisson(df, "f", 1 / (n - 1), 1e-4, 120, 40)
    assert array(solved, (n, n)) == pytest.approx(exact, abs=0.05) and steps <= 120
    with pytest.raises(ValueError):
        M.heat(df, 0.3, 1)


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a) if v], "i long, j long, v double")


def test_matrices(spark):
    a, b = np.array([[1, 2], [0, 3]]), np.array([[0, 1], [4, 5]])
    got = {(r["i"], r["j"]): r["v"] for r in X.multiply(coo(spark, a), coo(spark, b)).collect()}
    assert got == {(i, j): v for (i, j), v in np.ndenumerate(a @ b) if v}
    assert X.trace(coo(spark, a)).first()[0] == 4 and X.frobenius(coo(spark, a)).first()[0] == pytest.approx(math.sqrt(14))
    s = np.array([[4.0, 1], [1, 3]])
    x, steps = X.conjugate_gradient(coo(spark, s), spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, v double"))
    assert [r["v"] for r in x.orderBy("i").collect()] == pytest.approx(np.linalg.solve(s, [1, 2])) and steps <= 2


@pytest.mark.parametrize("kind", mixture.KINDS)
def test_mixture(spark, kind):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(8, 1, (150, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    model = mixture.fit(df, [[1.0, 1.0], [6.0, 6.0]], kind)
    assert sorted(model.means[:, 0].round()) == [0, 8]
    labels = [r["label"] for r in mixture.predict(df, model).orderBy("id").collect()]
    assert labels == [0] * 150 + [1] * 150
    c = mixture.information_criteria(df, model).first()
    assert c["bic"] > c["aic"]


def test_betweenness(spark):
    rows = [(0, 1), (1, 2), (2, 3), (1, 4)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in rows] + [(b, a, 1.0) for a, b in rows], "src long, dst long, w double")
    got = {r["id"]: r["centrality"] for r in G.betweenness_centrality(e, spark.range(5), False, False).collect()}
    assert got == {0: 0, 1: 5, 2: 3, 3: 0, 4: 0}


def test_gaussian_mixture_query_takes_whole_vectors(spark, sf):
    from sparksci.plans import QUERIES
    from sparksci.plans.spatial import embedded

    held = embedded(spark, sf).orderBy("id").collect()
    x = np.array([r["v"] for r in held])
    w, m, c = np.full(3, 1 / 3), x[:3], np.ones((3, x.shape[1]))
    density = lambda: np.log(w) - 0.5 * (((x[:, None] - m) ** 2 / c).sum(2) + np.log(2 * np.pi * c).sum(1))
    last = None
    for _ in range(10):
        p = density()
        total = np.logaddexp.reduce(p, axis=1)
        g = np.exp(p - total[:, None])
        n = g.sum(0)
        w, m = n / n.sum(), g.T @ x / n[:, None]
        c = g.T @ (x * x) / n[:, None] - m**2 + 1e-6
        if last is not None and abs(total.mean() - last) < 1e-3:
            break
        last = total.mean()
    got = {r["id"]: (r["label"], r["score"]) for r in QUERIES["gaussian_mixture"](spark, sf).collect()}
    p = density()
    assert [got[r["id"]][0] for r in held] == p.argmax(1).tolist()
    assert [got[r["id"]][1] for r in held] == pytest.approx(np.logaddexp.reduce(p, axis=1).tolist(), abs=1e-3)


def test_iterations_keep_small_estimates(spark):
    n = 600
    e = spark.range(n).select(F.xxhash64("id").alias("src"), F.xxhash64(F.col("id") + 1).alias("dst"))
    out = G.connected_components(e, spark.range(n + 1).select(F.xxhash64("id").alias("id")))
    assert out.select("component").distinct().count() == 1
    # Estimates of joins multiply: over the rounds of a long way the digits themselves would grow by a power.
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 100


def _between(links: dict[int, set[int]]) -> dict[int, float]:
    """Brandes' sums over ordered pairs."""
    out = dict.fromkeys(links, 0.0)
    for s in links:
        far, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in links[v]:
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in links[w]:
                if far[v] == far[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                out[w] += dep[w]
    return out


@pytest.mark.parametrize("folds", [16, 1])
def test_betweenness_folds_branches(spark, monkeypatch, folds):
    monkeypatch.setattr(G, "FOLDS", folds)
    rng = random.Random(folds)
    pairs = {(0, 1), (1, 2), (2, 3), (3, 0), (1, 3), (30, 31), (40, 41), (41, 42)} | {(k, rng.randrange(k)) for k in range(4, 24)}
    links = {v: set() for p in pairs for v in p} | {50: set()}
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    e = spark.createDataFrame([(a, b, 1.0) for a in links for b in links[a]], "src long, dst long, w double")
    seen = []
    real = G._dependencies
    monkeypatch.setattr(G, "_dependencies", lambda links, sources, held: seen.append(held.count()) or real(links, sources, held))
    got = {r["id"]: r["centrality"] for r in G.betweenness_centrality(e, spark.createDataFrame([(v,) for v in links], "id long"), True, False).collect()}
    assert got == pytest.approx(_between(links))
    assert folds == 1 or seen == [7]  # the cycle and a node of every other component
