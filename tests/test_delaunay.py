"""Triangulations by tiles against the definition: circles without points, in every tiling the same."""

import math
import random
from fractions import Fraction
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sparksci.operators import delaunay as D


def frame(spark, pts):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in pts.items()], "id long, x double, y double")


def in_circle(a, b, c, p):
    rows = [[Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])] for q in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    return (ax**2 + ay**2) * (bx * cy - by * cx) - (bx**2 + by**2) * (ax * cy - ay * cx) + (cx**2 + cy**2) * (ax * by - ay * bx)


def area(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def checked(pts, rows):
    """No point lies in a circle, no triangle is flat or repeated, and the areas fill the hull."""
    found = [(r["a"], r["b"], r["c"]) for r in rows]
    assert len(set(found)) == len(found)
    whole = 0.0
    for t in found:
        a, b, c = (pts[i] for i in t)
        assert area(a, b, c) > 0
        whole += area(a, b, c)
        assert all(in_circle(a, b, c, p) <= 0 for i, p in pts.items() if i not in t)
    at = sorted(set(pts.values()))
    chain = []
    for line in (at, at[::-1]):
        part = []
        for p in line:
            while len(part) > 1 and area(part[-2], part[-1], p) <= 0:
                part.pop()
            part.append(p)
        chain += part[:-1]
    hull = sum(area(chain[0], chain[i - 1], chain[i]) for i in range(2, len(chain)))
    assert math.isclose(whole, hull, rel_tol=1e-9)
    return set(found)


def test_random_points_in_any_tiling(spark):
    rng = random.Random(4)
    pts = {i * 7 - 300: (rng.gauss(0, 1), rng.random()) for i in range(160)}
    small = checked(pts, D.delaunay(frame(spark, pts), size=12).collect())
    assert small == checked(pts, D.delaunay(frame(spark, pts)).collect())


def test_ties_on_circles_and_lines(spark):
    """A grid has four points on every circle and many on every line; ids in no order."""
    ids = list(range(81))
    random.Random(5).shuffle(ids)
    pts = {ids[k]: (float(k % 9), float(k // 9)) for k in range(81)}
    small = checked(pts, D.delaunay(frame(spark, pts), size=10).collect())
    assert len(small) == 2 * 8 * 8
    assert small == checked(pts, D.delaunay(frame(spark, pts)).collect())


def test_hot_line_and_far_offset(spark):
    """Half of the points share an x; coordinates far from 0 leave few digits."""
    rng = random.Random(6)
    pts = {i: (1e7 + (0.5 if i % 2 else rng.random()), 1e7 + rng.random()) for i in range(120)}
    assert checked(pts, D.delaunay(frame(spark, pts), size=10).collect()) == checked(pts, D.delaunay(frame(spark, pts)).collect())


def test_points_on_one_circle_reach_the_root(spark):
    pts = {i: (math.cos(i), math.sin(i)) for i in range(60)}
    pts[60] = (0.01, 0.02)
    assert len(checked(pts, D.delaunay(frame(spark, pts), size=8).collect())) == 2 * 61 - 2 - 60


@pytest.mark.parametrize("rows", [[], [(1, 0.0, 0.0), (2, 1.0, 1.0)], [(i, float(i), 2.0 * i) for i in range(30)]])
def test_no_triangles(spark, rows):
    assert D.delaunay(spark.createDataFrame(rows, "id long, x double, y double"), size=5).count() == 0


def test_defined_cases(spark):
    rows = [(3, 0.0, 0.0), (9, -0.0, 0.0), (1, 4.0, 0.0), (2, 0.0, 3.0), (2, 9.0, 9.0), (None, 5.0, 5.0), (5, None, 1.0), (6, float("nan"), 1.0), (7, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double").withColumn("path", F.lit("a")).withColumn("kind", F.lit(1))
    got = D.delaunay(df).collect()
    assert [(r["a"], r["b"], r["c"], r["ax"], r["ay"]) for r in got] == [(1, 2, 3, 4.0, 0.0)]


def test_find_simplex(spark):
    rng = random.Random(8)
    pts = {i: (rng.random(), rng.random()) for i in range(120)}
    asked = {i: (rng.random() * 1.2 - 0.1, rng.random() * 1.2 - 0.1) for i in range(150)} | {1000 + i: pts[i] for i in range(120)}
    tri = checked(pts, D.delaunay(frame(spark, pts)).collect())
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in D.find_simplex(frame(spark, pts), frame(spark, asked), size=10).collect()}
    assert set(got) == set(asked)
    for i, q in asked.items():
        holders = {t for t in tri if all(D._turn(pts[t[k]], pts[t[(k + 1) % 3]], q) >= 0 for k in range(3))}
        assert got[i] in holders if holders else got[i] == (None, None, None)


def test_voronoi(spark):
    rng = random.Random(9)
    pts = {i: (rng.random(), rng.random()) for i in range(80)}
    tri = D.delaunay(frame(spark, pts), size=20).cache()
    near = {(r["id"], r["neighbor"]) for r in D.vertex_neighbors(tri).collect()}
    sides = {e for r in tri.collect() for e in combinations(sorted((r["a"], r["b"], r["c"])), 2)}
    assert near == sides | {(v, u) for u, v in sides}
    hull = {(r["u"], r["v"]) for r in D.hull_edges(tri).collect()}
    assert {u for u, _ in hull} == {v for _, v in hull} and len(sides) == 3 * 80 - 3 - len(hull)
    regions = {r["id"]: r for r in D.voronoi_regions(tri).collect()}
    assert {i for i, r in regions.items() if not r["bounded"]} == {u for u, _ in hull}
    for r in D.voronoi_vertices(tri).collect():
        far = [math.dist(pts[r[k]], (r["vx"], r["vy"])) for k in "abc"]
        assert max(far) - min(far) < 1e-6 * max(1, max(far))
    corners = {}
    for r in D.voronoi_vertices(tri).collect():
        for k in "abc":
            corners.setdefault(r[k], []).append((r["vx"], r["vy"]))
    for i, r in regions.items():
        assert r["n_vertices"] == len(corners[i]) and r["n_neighbors"] == sum(u == i for u, _ in near)
        if r["bounded"]:
            ring = sorted(corners[i], key=lambda p: math.atan2(p[1] - pts[i][1], p[0] - pts[i][0]))
            ring_area = sum(ring[k - 1][0] * ring[k][1] - ring[k - 1][1] * ring[k][0] for k in range(len(ring))) / 2
            assert math.isclose(r["area"], ring_area, rel_tol=1e-6)
        else:
            assert r["area"] is None
    rays = [r for r in D.voronoi_ridges(tri).collect() if r["x2"] is None]
    assert {(r["i"], r["j"]) for r in rays} == {tuple(sorted(e)) for e in hull}
