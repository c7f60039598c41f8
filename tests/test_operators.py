"""Series, interpolation, spatial, cluster, graph and morphology operators on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksci.functions import vectors as V
from sparksci.operators import cluster as C
from sparksci.operators import graph as G
from sparksci.operators import interpolate as P
from sparksci.operators import morphology as M
from sparksci.operators import series as S
from sparksci.operators import spatial as X


def series(spark, *values, by="a"):
    return spark.createDataFrame([(by, float(i), float(v)) for i, v in enumerate(values)], "s string, t double, x double")


def values(df, column="value", order="pos"):
    return [r[column] for r in df.orderBy(order).collect()]


def test_integrals(spark):
    parabola = spark.createDataFrame([("a", i / 100, (i / 100) ** 2) for i in range(101)], "s string, t double, x double")
    assert S.trapezoid(parabola, "x", "t", "s").first()["integral"] == pytest.approx(1 / 3, abs=1e-3)
    assert S.simpson(parabola, "x", "t", "s").first()["integral"] == pytest.approx(1 / 3, abs=1e-12)
    assert values(S.cumulative_trapezoid(series(spark, 1, 2, 3), "x", "t", "s"), "cumulative", "t") == [0, 1.5, 4]
    assert S.trapezoid(series(spark, 5), "x", "t", "s").first()["integral"] == 0


def test_convolution(spark):
    df = series(spark, 1, 2, 3, 4, 5)
    kernel = [1.0, 0.0, -1.0]
    assert values(S.convolve(df, "x", "t", kernel, "s")) == [1, 2, 2, 2, 2, -4, -5]
    assert values(S.convolve(df, "x", "t", kernel, "s", "same")) == [2, 2, 2, 2, -4]
    assert values(S.convolve(df, "x", "t", kernel, "s", "valid")) == [2, 2, 2]
    assert values(S.correlate(df, "x", "t", [0.0, 1.0, 2.0], "s")) == np.correlate([1, 2, 3, 4, 5], [0, 1, 2], "full").tolist()


def test_filters(spark):
    df = series(spark, 1, 1, 1, 100, 1, 1, 1)
    assert values(S.medfilt(df, "x", "t", "s", 3), "medfilt", "t") == [1] * 7
    assert values(S.medfilt(series(spark, 3, 1, 2), "x", "t", "s", 3), "medfilt", "t") == [3, 2, 2]
    with pytest.raises(ValueError):
        S.medfilt(df, "x", "t", "s", 4)
    short = series(spark, 1, 2, 4)
    assert values(S.uniform_filter(short, "x", "t", "s", 3, "reflect")) == pytest.approx([5 / 3, 7 / 3, 8 / 3])
    assert values(S.uniform_filter(short, "x", "t", "s", 3, "mirror")) == pytest.approx([4 / 3, 7 / 3, 10 / 3])
    assert values(S.uniform_filter(short, "x", "t", "s", 3, "nearest")) == pytest.approx([4 / 3, 7 / 3, 10 / 3])
    assert values(S.uniform_filter(short, "x", "t", "s", 3, "wrap")) == pytest.approx([7 / 3] * 3)
    assert values(S.uniform_filter(short, "x", "t", "s", 3, "constant")) == pytest.approx([1, 7 / 3, 2])
    assert values(S.minimum_filter(short, "x", "t", "s")) == [1, 1, 2] and values(S.maximum_filter(short, "x", "t", "s")) == [2, 4, 4]
    line = series(spark, *range(9))
    assert values(S.savgol_filter(line, "x", "t", "s", 5, 2))[2:7] == pytest.approx([2, 3, 4, 5, 6])
    assert values(S.detrend(line, "x", "t", "s"), "detrended", "t") == pytest.approx([0] * 9)
    assert sum(S.gaussian_kernel(1.5)) == pytest.approx(1)


def test_extrema(spark):
    df = series(spark, 1, 0.5, 0, 0.5, 1, 0.5, 0, 0.5, 1)
    assert values(S.argrel(df, "x", "t", "s", "min"), "pos") == [2, 6]
    assert values(S.find_peaks(df, "x", "t", "s"), "pos") == [4]
    assert values(S.argrel(series(spark, 1, 1, 1), "x", "t", "s", "min"), "pos") == []
    assert values(S.decimate(df, "t", 4, "s"), "t", "t") == [0, 4, 8]


def test_spectra(spark):
    tone = series(spark, *(math.sin(2 * math.pi * 10 * i / 100) for i in range(1000)))
    psd = S.welch(tone, "x", "t", "s", fs=100.0, nperseg=256).orderBy(F.desc("psd")).first()
    assert abs(psd["freq"] - 10) < 1
    frames = S.stft(tone, "x", "t", "s", 64)
    assert frames.select("frame").distinct().count() == (1000 - 64) // 16 + 1
    peak = S.lombscargle(tone, "x", "t", [0.3, 2 * math.pi / 10, 1.5], "s").orderBy(F.desc("power")).first()
    assert peak["freq"] == pytest.approx(2 * math.pi / 10)
    dwt = S.haar_dwt(series(spark, 1, 4, 3, 5), "x", "t", "s").orderBy("pos").collect()
    assert [(r["approx"], r["detail"]) for r in dwt] == [(pytest.approx(5 / 2**0.5), pytest.approx(-3 / 2**0.5)), (pytest.approx(8 / 2**0.5), pytest.approx(-2 / 2**0.5))]


def test_interpolation(spark):
    knots = series(spark, 0, 10, 20, 0)
    asked = spark.createDataFrame([("a", i, q) for i, q in enumerate((-1.0, 0.25, 1.5, 2.5, 3.0, 4.0))], "s string, i long, q double")
    got = values(P.interp1d(knots, asked, "t", "x", "q", "s"), "value", "i")
    assert got == pytest.approx([-10, 2.5, 15, 10, 0, -20])
    assert values(P.interp1d(knots, asked, "t", "x", "q", "s", "nearest"), "value", "i") == [0, 0, 20, 0, 0, 0]
    straight = series(spark, 1, 3, 5, 7)
    for slopes in (P.pchip_slopes, P.akima_slopes):
        assert values(slopes(straight, "t", "x", "s"), "slope", "t") == pytest.approx([2, 2, 2, 2])
        assert values(slopes(series(spark, 1, 4), "t", "x", "s"), "slope", "t") == pytest.approx([3, 3])
    smooth = P.hermite(P.pchip_slopes(straight, "t", "x", "s"), asked.where("q BETWEEN 0 AND 3"), "t", "x", "slope", "q", "s")
    assert values(smooth, "value", "i") == pytest.approx([1.5, 4, 6, 7])


def points(spark, *rows):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], "id long, v array<double>")


def test_distances(spark):
    a, b = points(spark, (0, 0), (1, 0), (0, 1)), points(spark, (1, 1), (2, 2))
    d = {(r["query_id"], r["id"]): r["distance"] for r in X.cdist(a, b).collect()}
    assert d[0, 0] == pytest.approx(math.sqrt(2)) and len(d) == 6
    assert X.squareform(X.pdist(a)).count() == 9 and X.condensed(X.squareform(X.pdist(a))).count() == 3
    square = points(spark, (0, 0), (1, 0), (1, 1), (0, 1))
    assert [r["id"] for r in X.knn(square, points(spark, (0.1, 0.1)), 2).orderBy("rank").collect()] == [0, 1]
    assert X.knn(square, points(spark, (0.1, 0.1)), 9).count() == 4
    near = {(r["query_id"], r["id"]) for r in X.radius_join(square, square, 1.0).collect()}
    assert len(near) == 12 and (0, 2) not in near


def test_rotations(spark):
    lit = lambda *x: [F.lit(float(c)) for c in x]
    q = V.quat_from_euler("XYZ", *lit(0, 0, math.pi / 2))
    r = spark.range(1).select(V.quat_to_matrix(q).alias("m"), V.rotate(q, F.array(*lit(1, 0, 0))).alias("v"), V.quat_to_rotvec(q).alias("r"), V.quat_from_matrix(V.quat_to_matrix(q)).alias("q")).first()
    assert r["m"][0][1] == pytest.approx(-1) and r["v"] == pytest.approx([0, 1, 0]) and r["r"] == pytest.approx([0, 0, math.pi / 2])
    assert list(r["q"]) == pytest.approx([math.sqrt(0.5), 0, 0, math.sqrt(0.5)])
    half = V.slerp(V.quat_from_rotvec(*lit(0, 0, 0)), q, F.lit(0.5))
    assert spark.range(1).select(V.quat_magnitude(half)).first()[0] == pytest.approx(math.pi / 4)


def test_clusters(spark):
    df = points(spark, (0, 0), (0.1, 0.1), (0.2, 0), (10, 10), (10.1, 10.1), (10.2, 10))
    centers, inertia, _ = C.kmeans(df, [[0.0, 0.0], [10.0, 10.0]])
    assert [r["label"] for r in C.kmeans_predict(df, centers).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1] and inertia < 1
    labelled = C.kmeans_predict(df, centers).join(df, "id")
    assert C.silhouette_score(labelled).first()[0] > 0.9
    assert C.calinski_harabasz_score(labelled).first()[0] > 1000 and C.davies_bouldin_score(labelled).first()[0] < 0.1
    two = points(spark, (0, 0), (0.1, 0), (0, 0.1), (5, 5), (5.1, 5), (5, 5.1), (100, 100))
    assert [r["label"] for r in C.dbscan(two, 1.0, 2).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, -1]
    same = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1)], "a long, b long")
    assert C.adjusted_rand_score(same, "a", "b").first()[0] == pytest.approx(1)
    assert C.normalized_mutual_info_score(same, "a", "b").first()[0] == pytest.approx(1)
    assert list(C.homogeneity_completeness_v_measure(same, "a", "b").first()) == pytest.approx([1, 1, 1])
    assert C.adjusted_rand_score(same.selectExpr("0 AS a", "0 AS b"), "a", "b").first()[0] == 0


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


def both(*rows):
    return [*rows, *((b, a, w) for a, b, w in rows)]


def table(df, *columns):
    return {r[0]: r[1] for r in df.select(*columns).collect()}


def test_shortest_paths(spark):
    e = edges(spark, (0, 1, 1), (1, 2, 2), (0, 2, 10))
    got = {r["id"]: (r["distance"], r["predecessor"]) for r in G.shortest_paths(e, spark.range(1)).collect()}
    assert got == {0: (0, -1), 1: (1, 0), 2: (3, 1)}
    assert G.shortest_paths(e, spark.range(2, 3)).count() == 1


def test_centralities(spark):
    k3 = edges(spark, *both((0, 1, 1), (1, 2, 1), (0, 2, 1)))
    assert table(G.degree_centrality(k3, spark.range(3)), "id", "centrality") == {0: 1, 1: 1, 2: 1}
    chain = G.pagerank(edges(spark, (0, 1, 1), (1, 2, 1)), spark.range(3))
    rank = table(chain, "id", "rank")
    assert sum(rank.values()) == pytest.approx(1, abs=1e-6) and rank[2] > rank[1]
    star = table(G.eigenvector_centrality(edges(spark, *both((0, 1, 1), (0, 2, 1), (0, 3, 1), (1, 2, 1))), spark.range(4)), "id", "centrality")
    assert max(star, key=star.get) == 0
    assert table(G.closeness_centrality(edges(spark, (0, 1, 1), (1, 2, 1)), spark.range(3)), "id", "centrality") == {0: pytest.approx(2 / 3), 1: 1, 2: 0}


def test_components(spark):
    e = edges(spark, *both((0, 1, 1), (2, 3, 1)))
    assert table(G.connected_components(e, spark.range(5)), "id", "component") == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert not G.is_connected(e, spark.range(5)) and G.is_connected(e.where("src < 2"), spark.range(2))
    path = edges(spark, *((i, i + 1, 1) for i in range(30)))
    assert set(table(G.connected_components(path, spark.range(31)), "id", "component").values()) == {0}
    loop = edges(spark, (0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 3, 1), (3, 4, 1), (4, 3, 1))
    assert table(G.strongly_connected_components(loop, spark.range(6)), "id", "component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_trees_and_matrices(spark):
    e = edges(spark, *both((0, 1, 1), (1, 2, 2), (0, 2, 3)))
    tree = G.minimum_spanning_tree(e, spark.range(3))
    assert tree.agg(F.sum("w")).first()[0] == 3
    lap = {(r["i"], r["j"]): r["v"] for r in G.laplacian_matrix(e, spark.range(4)).collect()}
    assert lap[0, 0] == 2 and lap[0, 1] == -1 and lap[3, 3] == 0
    assert G.incidence_matrix(e, False).count() == 6


def image(spark, rows):
    return spark.createDataFrame([(0, y, x, float(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "img int, y int, x int, v double")


def grid(df):
    out = {}
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_morphology(spark):
    block = image(spark, [[1 if 1 <= y <= 3 and 1 <= x <= 3 else 0 for x in range(5)] for y in range(5)])
    assert [k for k, v in grid(M.binary_erosion(block)).items() if v] == [(2, 2)]
    assert sum(grid(M.binary_dilation(block)).values()) == 25
    assert grid(M.binary_opening(block)) == grid(block) == grid(M.grey_opening(block))
    assert sum(grid(M.white_tophat(block)).values()) == 0
    full = image(spark, [[1] * 3] * 3)
    assert sum(grid(M.binary_erosion(full)).values()) == 1 and sum(grid(M.grey_erosion(full)).values()) == 9


def test_labels(spark):
    two = image(spark, [[1, 1, 0, 0, 0], [1, 1, 0, 0, 0], [0] * 5, [0, 0, 0, 1, 1], [0, 0, 0, 1, 1]])
    labelled = M.label(two)
    boxes = {r["label"]: (r["y0"], r["y1"], r["x0"], r["x1"], r["area"]) for r in M.find_objects(labelled).collect()}
    assert boxes == {1: (0, 2, 0, 2, 4), 2: (3, 5, 3, 5, 4)}
    assert {r["label"]: (r["sum"], r["cy"], r["cx"]) for r in M.label_statistics(labelled).collect()} == {1: (4, 0.5, 0.5), 2: (4, 3.5, 3.5)}
    diagonal = image(spark, [[1, 0], [0, 1]])
    assert M.label(diagonal).agg(F.max("label")).first()[0] == 2 and M.label(diagonal, True).agg(F.max("label")).first()[0] == 1


def test_hulls(spark):
    rng = np.random.default_rng(0)
    corners = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    rows = [("a", v) for v in corners + (0.1 + 0.8 * rng.random((50, 2))).tolist()] + [("b", [2.0, 2.0])]
    hull = X.convex_hull(spark.createDataFrame(rows, "g string, v array<double>"), "g")
    assert [[r["x"], r["y"]] for r in hull.where("g = 'a'").orderBy("k").collect()] == corners
    m = {r["g"]: (r["area"], r["perimeter"]) for r in X.hull_measures(hull, "g").collect()}
    assert m == {"a": (1, 4), "b": (0, 0)}


def test_single_linkage(spark):
    df = points(spark, (0, 0), (1, 0), (3, 0), (10, 0))
    merges = C.single_linkage(df)
    assert [r["distance"] for r in merges.orderBy("step").collect()] == [1, 2, 7]
    assert {r["id"]: r["label"] for r in C.fcluster(df, merges, 2.5).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_wavelets(spark):
    df = series(spark, 1, 4, 3, 5, 8, 2, 7, 6)
    for wavelet, size in (("haar", 2), ("db2", 4)):
        got = S.dwt(df, "x", "t", "s", wavelet, "zero").orderBy("pos").collect()
        low = S.WAVELETS[wavelet]
        ends = [0.0] * (size - 1)
        full = np.correlate(ends + [1, 4, 3, 5, 8, 2, 7, 6] + ends, low, "valid")[::2]
        assert [r["approx"] for r in got] == pytest.approx(full.tolist())


def test_wavelet_filters_and_inverses(spark):
    y = [1.0, 4, 3, 5, 8, 2, 7, 6, 9, 1, 2]
    df = series(spark, *y)

    def extend(v, pad, how):
        """The ends by their definition, value by value."""
        v, n = list(v), len(v)
        if how == "zero":
            return [0.0] * pad + v + [0.0] * pad
        if how == "constant":
            return [v[0]] * pad + v + [v[-1]] * pad
        if how == "smooth":
            return [v[0] - (v[1] - v[0]) * (i + 1) for i in reversed(range(pad))] + v + [v[-1] + (v[-1] - v[-2]) * (i + 1) for i in range(pad)]
        if how == "periodic":
            return [v[i % n] for i in reversed(range(pad))] + v + [v[i % n] for i in range(pad)]
        return [v[i if i < n else max(0, 2 * n - 2 - i)] for i in reversed(range(pad))] + v + [v[n - 2 - i] if n > 1 + i else v[i % n] for i in range(pad)]

    def forward(v, low, how):
        high = [c * (-1) ** (k + 1) for k, c in enumerate(low)][::-1]
        ext = extend(v, len(low) - 1, how)
        return [np.correlate(ext, f, "valid")[::2] for f in (low, high)]

    def back(a, d, low, how):
        high = [c * (-1) ** (k + 1) for k, c in enumerate(low)][::-1]
        both = [np.correlate(extend(np.ravel(np.column_stack([v, 0 * v])), len(low) - 1, how), f[::-1], "valid") for v, f in ((a, low), (d, high))]
        n = min(map(len, both))
        return both[0][:n] + both[1][:n]

    assert np.allclose(forward(y, S.WAVELETS["haar"], "zero")[1][1], (4 - 3) / 2**0.5)  # the earlier value less the later one
    for wavelet, how in (("haar", "zero"), ("db2", "symmetric"), ("db3", "periodic"), ("db4", "constant"), ("db3", "smooth")):
        low = S.WAVELETS[wavelet]
        a, d = forward(y, low, how)
        got = S.dwt(df, "x", "t", "s", wavelet, how)
        rows = got.orderBy("pos").collect()
        assert np.allclose([(r["approx"], r["detail"]) for r in rows], np.column_stack([a, d]))
        inverse = [r["value"] for r in S.idwt(got, "s", wavelet, how).orderBy("pos").collect()]
        assert np.allclose(inverse, back(a, d, low, how))
        if how == "zero":
            assert np.allclose(inverse[len(low) - 1 : len(low) - 1 + len(y)], y)
    low = S.WAVELETS["db2"]
    coeffs = S.wavedec(df, "x", "t", "s", "db2", "symmetric", 2)
    a1, d1 = forward(y, low, "symmetric")
    a2, d2 = forward(a1, low, "symmetric")
    for level, part, want in ((1, "detail", d1), (2, "detail", d2), (2, "approx", a2)):
        assert np.allclose([r["value"] for r in coeffs.where(f"level = {level} AND part = '{part}'").orderBy("pos").collect()], want)
    got = [r["value"] for r in S.waverec(coeffs, "s", "db2", "symmetric", 2).orderBy("pos").collect()]
    assert np.allclose(got, back(back(a2, d2, low, "symmetric"), d1, low, "symmetric"))
    last = S.dwt(series(spark, 1, 4, 3, 5, 8, 2, 7, 6), "x", "t", "s", "db2").orderBy("pos").collect()[-2:]
    assert [r["approx"] for r in last] == pytest.approx([7.2605, 8.1664], abs=1e-4)
    short = S.dwt(series(spark, 1, 2), "x", "t", "s", "db4").orderBy("pos").collect()  # shorter than the filter
    assert np.allclose([(r["approx"], r["detail"]) for r in short], np.column_stack(forward([1.0, 2.0], S.WAVELETS["db4"], "symmetric")))


def test_map_coordinates(spark):
    from sparksci.operators import images

    df = image(spark, [[0, 1, 2], [10, 11, 12]])
    asked = spark.createDataFrame([(0, 0, 0.5, 0.5), (0, 1, 1.0, 2.0), (0, 2, -3.0, 9.0), (0, 3, 0.25, 1.0)], "img int, qid int, yq double, xq double")
    got = {r["qid"]: r["value"] for r in images.map_coordinates(df, asked).collect()}
    assert got == pytest.approx({0: 5.5, 1: 12, 2: 2, 3: 3.5})
    assert {r["qid"]: r["value"] for r in images.map_coordinates(df, asked, "nearest").collect()}[3] == 1


def test_resampled_images(spark):
    from sparksci.operators import images

    def got(df):
        held = {(r["y"], r["x"]): r["v"] for r in df.collect()}
        return [[pytest.approx(held.pop((y, x)), abs=1e-9) for x in range(max(k[1] for k in held) + 1)] for y in range(max(k[0] for k in held) + 1)] if held else []

    small = image(spark, [[0, 1], [2, 3]])
    assert got(images.affine_transform(small, [[1, 0], [0, 1]])) == [[0, 1], [2, 3]]
    assert got(images.affine_transform(small, [[0, 1], [1, 0]], shape=(2, 1))) == [[0], [1]]
    assert got(images.zoom(small, (2, 2))) == [[0, 0.5, 1, 1], [1, 1.5, 2, 2], [2, 2.5, 3, 3], [2, 2.5, 3, 3]]
    assert got(images.zoom(small, (0.5, 1))) == [[0, 1]] and images.zoom(small, (0.1, 1)).count() == 0
    assert got(images.shift(small, (1, 0))) == [[0, 1], [0, 1]]
    assert got(images.shift(small, (0, -0.5))) == [[0.5, 1], [2.5, 3]]
    assert got(images.rotate(small, 90)) == [[1, 3], [0, 2]]
    wide = image(spark, [[1, 2, 3], [4, 5, 6]])
    assert got(images.rotate(wide, 90, reshape=True)) == [[3, 6], [2, 5], [1, 4]]
    assert got(images.rotate(wide, 180, order="nearest")) == [[6, 5, 4], [3, 2, 1]]
    assert images.rotate(wide.limit(0), 45).count() == 0
    with pytest.raises(ValueError):
        images.zoom(small, (0, 1))


def test_whole_graph_queries(spark, sf, monkeypatch):
    from sparksci.plans import QUERIES

    nations = table(spark.read.parquet(f"{sf}/nation.parquet"), "n_nationkey", "n_regionkey")
    held = table(spark.read.parquet(f"{sf}/customer.parquet").groupBy("c_nationkey").count(), "c_nationkey", "count")
    customers = [r["c_custkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").collect()]
    size = {k: held.get(k, 0) + 1 for k in nations}
    regions = {r: sum(size[k] for k in nations if nations[k] == r) + 1 for r in nations.values()}
    n = sum(regions.values())
    inside = lambda parts: (sum(parts) ** 2 - sum(p * p for p in parts)) / 2
    want = {k: 0.0 for k in customers}
    for k, r in nations.items():
        whole = regions[r]
        want[20_000_000 + k] = inside([1] * (size[k] - 1) + [whole - size[k]])
        want[10_000_000 + r] = inside([size[j] for j in nations if nations[j] == r])
    scale = 2 / ((n - 1) * (n - 2))
    monkeypatch.setattr(G, "PAIRS", n * n // 2)
    got = table(QUERIES["betweenness_centrality"](spark, sf), "id", "centrality")
    assert got == pytest.approx({k: v * scale for k, v in want.items()}, abs=1e-4)
    orders = spark.read.parquet(f"{sf}/orders.parquet").collect()
    want = {r["o_orderkey"] + 1_000_000: r["o_custkey"] for r in orders} | {r["o_custkey"]: r["o_custkey"] for r in orders}
    assert table(QUERIES["connected_components_all"](spark, sf), "id", "component") == want


def test_whole_embedding_queries(spark, tmp_path, monkeypatch):
    from sparksci.plans import QUERIES

    rng = np.random.default_rng(5)
    v = np.concatenate([c + 0.2 * rng.standard_normal((8, 4)) for c in (0.0, 5.0, 9.0)] + [[[40.0] * 4]])
    spark.createDataFrame([(i, x, i % 10) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(X, "BLOCK", 7)  # several blocks
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    got = {(r["i"], r["j"]): r["distance"] for r in QUERIES["pdist_all"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(i, j): d[i, j] for i in range(len(v)) for j in range(i + 1, len(v))}, abs=1e-4)
    square = {(r["i"], r["j"]): r["distance"] for r in QUERIES["squareform_all"](spark, str(tmp_path)).collect()}
    assert square == pytest.approx({(i, j): d[i, j] for i in range(len(v)) for j in range(len(v))}, abs=1e-4)
    # brute force: links with a core point at either end, clusters numbered by their least id
    core = (d <= 1.0).sum(1) >= 5
    links = (d <= 1.0) & (core[:, None] | core)
    root = np.arange(len(v))
    for _ in v:
        root = np.array([min(root[links[i]], default=root[i]) for i in range(len(v))])
    names = sorted({root[i] for i in range(len(v)) if links[i].any()})
    want = {i: names.index(root[i]) if links[i].any() else -1 for i in range(len(v))}
    assert len(names) == 3
    assert table(QUERIES["dbscan_all"](spark, str(tmp_path)), "id", "label") == want


def test_squareform_computes_pairs_once(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 1.5), (2, 3, 2.0)], "i long, j long, distance double").mapInPandas(count, "i long, j long, distance double")
    got = {(r["i"], r["j"]): r["distance"] for r in X.squareform(pairs, ids).collect()}
    assert got == {(1, 2): 0.5, (2, 1): 0.5, (1, 3): 1.5, (3, 1): 1.5, (2, 3): 2.0, (3, 2): 2.0, (1, 1): 0.0, (2, 2): 0.0, (3, 3): 0.0}
    assert seen.value == 3


def test_passes_leave_links_in_their_buckets(spark, capsys):
    from pyspark.sql import functions as F

    from sparksci.sources.tables import bucketed, forget

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        links = bucketed(spark.range(100).select((F.col("id") % 7).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w")), "src")
        met = links.join(spark.range(7).withColumnRenamed("id", "src"), "src")
        met.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1  # of the values, none of the links
        assert met.count() == 100 and not [t for t in spark.catalog.listTables() if t.name.startswith("sparksci_")]
        forget(links)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
