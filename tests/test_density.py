"""Block index, its searches, and density clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksci.operators import cluster, density, neighbours


def table(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def blobs(seed, sizes, d=2, spread=0.3, noise=0):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(5.0 * rng.normal(size=d), spread * (1 + k), size=(n, d)) for k, n in enumerate(sizes)]
    return np.round(np.concatenate([*parts, rng.uniform(-15, 15, size=(noise, d))]), 3)


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_searches_equal_brute_force(spark, metric):
    x = np.concatenate([blobs(1, [150, 100, 60], 3), blobs(1, [20], 3)])  # repeated points
    points = table(spark, x).union(spark.createDataFrame([(None, [0.0] * 3), (900, None), (901, [None, 1.0, 2.0]), (902, [float("nan"), 1.0, 2.0])], "id long, v array<double>"))
    d = neighbours.distances(x, x, metric)
    index = neighbours.build(points, metric, 32)
    assert index.blocks.count() > 8 and index.blocks.agg(F.sum(F.size("ids"))).first()[0] == len(x)
    near = {}
    for r in neighbours.knn(points, points, 7, metric).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), d[i]))[:7]
        assert sorted(near[i]) == [(k + 1, j, d[i, j]) for k, j in enumerate(order)]
    got = {(r["query_id"], r["id"]) for r in neighbours.radius_join(points, points.where("id % 3 = 0"), 0.5, metric).collect()}
    assert got == {(i, j) for i in range(0, len(x), 3) for j in range(len(x)) if d[i, j] <= 0.5}


def test_index_prunes_and_takes_few_rows(spark):
    points = table(spark, blobs(2, [400] * 5, 4, 0.1))
    index = neighbours.build(points, size=64)
    asked = index.blocks.withColumn("reach", F.lit(0.5))
    assert neighbours.searched_share(neighbours.block_pairs(asked, index.blocks), index.blocks, index.blocks) < 0.35
    few = table(spark, [[1.0, 2.0], [1.0, 3.0]])
    assert [(r["query_id"], r["rank"], r["id"]) for r in neighbours.knn(few, few, 5).orderBy("query_id", "rank").collect()] == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 0)]
    none = few.where("id < 0")
    assert neighbours.knn(none, few, 3).count() == 0 and neighbours.knn(few, none, 3).count() == 0 and neighbours.radius_join(none, none, 1.0).count() == 0


def test_dbscan_finds_clusters(spark):
    x = np.concatenate([blobs(3, [60, 40], 2, 0.2), [[40, 40], [-40, 40]]])
    got = {r["id"]: r["label"] for r in cluster.dbscan(table(spark, x), 1.0, 4).collect()}
    assert len(set(got[i] for i in range(60))) == 1 and got[100] == got[101] == -1
    assert {got[i] for i in range(60, 100)} != {got[0]}


def reach_matrix(x, k):
    d = neighbours.distances(x, x, "euclidean")
    core = np.sort(d, axis=1)[:, k]
    return np.maximum(np.maximum(d, core[:, None]), core)


def tree_by_hand(w):
    n, edges = len(w), []
    for i in range(n):
        edges += [(w[i, j], i, j) for j in range(i + 1, n)]
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    out = []
    for weight, i, j in sorted(edges):
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.append((weight, i, j))
    return out


def labels_by_hand(n, tree, size, method, single):
    """Clusters by walking the merge tree down from the root."""
    nodes, up = {i: (None, None, 0.0, [i]) for i in range(n)}, list(range(n))
    top = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (w, i, j) in enumerate(tree):
        a, b = find(i), find(j)
        nodes[n + k] = (top[a], top[b], w, nodes[top[a]][3] + nodes[top[b]][3])
        up[b], top[a] = a, n + k
    found = []

    def walk(node, birth, parent):
        me = len(found)
        found.append({"points": nodes[node][3], "birth": birth, "parent": parent, "s": 0.0, "below": []})
        if parent is not None:
            found[parent]["below"].append(me)
        while True:
            left, right, w, held = nodes[node]
            density = 1 / max(w, 1e-10)
            big = [c for c in (left, right) if len(nodes[c][3]) >= size]
            gone = len(held) if len(big) != 1 else len(held) - len(nodes[big[0]][3])
            found[me]["s"] += gone * (density - birth)
            if len(big) == 2:
                for c in big:
                    walk(c, density, me)
                return
            if not big:
                return
            node = big[0]

    walk(n + len(tree) - 1, 0.0, None)

    def best(c):
        below = [best(b) for b in found[c]["below"]]
        total = sum(t for t, _ in below)
        own = found[c]["s"] if c or single else float("-inf")
        if not below or (method == "eom" and own >= total):
            return own, [c] if own > float("-inf") else []
        return total, [k for _, ks in below for k in ks]

    labels = [-1] * n
    for label, c in enumerate(sorted(best(0)[1], key=lambda c: min(found[c]["points"]))):
        for p in found[c]["points"]:
            labels[p] = label
    return labels


def test_hdbscan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(density, "MERGES", 64)  # several ranges
    seed, size, k = 1, 5, 3
    x = np.concatenate([blobs(seed, [40, 30, 30, 20], 2, 0.3, 10), blobs(seed, [5], 2)])
    tree = tree_by_hand(reach_matrix(x, k))
    labels = {r["id"]: r["label"] for r in density.hdbscan(table(spark, x), size, k).collect()}
    assert [labels[i] for i in range(len(x))] == labels_by_hand(len(x), tree, size, "eom", False)
    assert len(set(labels.values())) > 2


def test_tree_of_copies_searches_near_blocks_only(spark, monkeypatch):
    """All neighbours of a copy are copies: no neighbour leads out of them, yet their way out is not sought in every block."""
    rng = np.random.default_rng(12)
    # Spots along lines; and one spot so full that blocks hold nothing else.
    x = np.concatenate([np.repeat([[12.0 * (k % 4), 0.37 * k + 0.01 * (k * k % 7)] for k in range(32)], 8, axis=0), np.repeat([[90.0, 5.0]], 50, axis=0)])
    x = x[rng.permutation(len(x))]
    counts = []

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return neighbours.meet(pairs, *rest)

    monkeypatch.setattr(density, "build", lambda points, metric: neighbours.build(points, metric, 16))
    monkeypatch.setattr(density, "meet", counted)
    got = sorted((r["w"], r["src"], r["dst"]) for r in density.mutual_spanning_tree(table(spark, x), 3).collect())
    assert got == sorted(tree_by_hand(reach_matrix(x, 3)))
    blocks = neighbours.build(table(spark, x), size=16).blocks.count()
    assert blocks > 16 and max(counts) < 0.6 * blocks**2


def test_selection_of_clusters(spark):
    """0 holds 1 and 2, 1 holds 3 and 4, 2 holds 5 and 6."""
    rows = [(0, None, 9.0), (1, 0, 3.0), (2, 0, 5.0), (3, 1, 2.0), (4, 1, 2.0), (5, 2, 1.0), (6, 2, 1.0)]
    clusters = spark.createDataFrame([(c, p, 0.0, s) for c, p, s in rows], "cluster long, parent long, birth double, stability double")
    read = lambda **k: {r["cluster"]: r["chosen"] for r in density.select_clusters(clusters, **k).collect()}
    assert read() == {0: None, 1: None, 2: 2, 3: 3, 4: 4, 5: 2, 6: 2}
    assert read(method="leaf") == {0: None, 1: None, 2: None, 3: 3, 4: 4, 5: 5, 6: 6}
    assert read(allow_single_cluster=True) == dict.fromkeys(range(7), 0)


def test_hdbscan_of_separate_groups_and_few_points(spark):
    group = [[0.0, 0.0], [0.1, 0.1], [0.2, 0.0], [0.0, 0.2], [0.1, 0.0]]
    x = group + [[a + 100, b + 100] for a, b in group]
    got = [r["label"] for r in density.hdbscan(table(spark, x), 3, 2).orderBy("id").collect()]
    assert got == [0] * 5 + [1] * 5
    few = spark.createDataFrame([(1, [1.0]), (2, [1.5]), (3, None)], "id long, v array<double>")
    assert [(r["id"], r["label"], r["probability"]) for r in density.hdbscan(few, 2, 2).orderBy("id").collect()] == [(1, -1, 0.0), (2, -1, 0.0), (3, -1, 0.0)]
    assert density.hdbscan(few.where("id < 0"), 2).count() == 0
    with pytest.raises(ValueError):
        density.hdbscan(few, 1)


def test_members_of_hdbscan_have_the_strength_of_their_stay(spark):
    """4 leaves its cluster at 1 / 2 of density 1; 109 at 1 / 3.8 where the others split at 1 / 1.2 and stay together longer than their halves."""
    x = [0.0, 1.0, 2.0, 4.0, 100.0, 101.0, 102.0, 103.2, 104.2, 105.2, 109.0, 1000.0]
    got = density.hdbscan(table(spark, [[c] for c in x]), 3, 1).orderBy("id").collect()
    assert [r["label"] for r in got] == [0] * 4 + [1] * 7 + [-1]
    assert np.allclose([r["probability"] for r in got], [1, 1, 1, 0.5, *[1] * 6, 1.2 / 3.8, 0])


def test_few_pointers_are_followed_in_one_task(spark, monkeypatch):
    """Ways of 40 nodes and a table of chosen clusters: no rounds of jobs below MERGES rows, and the same results as with rounds."""
    links = spark.createDataFrame([(k, max(0, k - 1), int(k > 0)) for k in range(40)], "node long, up long, add long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(39) if k != 20], "p long, q long")
    clusters = spark.createDataFrame([(0, None, 9.0), (1, 0, 3.0), (2, 0, 5.0), (3, 1, 2.0), (4, 1, 2.0)], "cluster long, parent long, stability double")
    roots, written, keep = spark.createDataFrame([(0,), (21,)], "point long"), [], density.stored
    monkeypatch.setattr(density, "stored", lambda df: written.append(1) or keep(df))

    def results():
        met = density.components(edges.select(F.col("p").alias("src"), F.col("q").alias("dst")), spark.range(41), 41)
        held = density.followed(links), density.rooted(edges, roots), density.select_clusters(clusters), met
        return [sorted(map(tuple, df.collect()), key=repr) for df in held]

    few = results()
    assert few[0] == sorted([(k, 0, k) for k in range(40)], key=repr) and few[1] == sorted([(k, k - 1) for k in range(1, 40) if k != 21], key=repr)
    assert few[3] == sorted([(k, 0 if k < 21 else 21 if k < 40 else 40) for k in range(41)], key=repr)
    assert len(written) == 2  # pointers and clusters, each once
    monkeypatch.setattr(density, "MERGES", 4)
    assert results() == few and len(written) > 15


def test_blocks_that_all_meet_go_by_tiles(spark, monkeypatch):
    """No pair of blocks is pruned: each block is shuffled once, and searches find what brute force does."""
    x = np.random.default_rng(8).normal(size=(120, 3))
    points, d = table(spark, x), neighbours.distances(x, x, "euclidean")
    monkeypatch.setattr(neighbours, "TILE", (2, 3))
    monkeypatch.setattr(neighbours, "build", lambda *a, keep=neighbours.build, **k: keep(*a[:2], 16, **k))
    tiles, keep = [], neighbours._tiled
    monkeypatch.setattr(neighbours, "_tiled", lambda *a: tiles.append(keep(*a)) or tiles[-1])
    near = neighbours.knn(points, points, 5).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in near} == {(i, k + 1, int(j)) for i in range(120) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    got = [(r["query_id"], r["id"]) for r in neighbours.radius_join(points, points, 2.0).collect()]
    assert sorted(got) == [(int(i), int(j)) for i, j in zip(*np.nonzero(d <= 2.0), strict=True)]
    assert len(tiles) == 2 and all("CartesianProduct" in t._jdf.queryExecution().executedPlan().toString() for t in tiles)
    # A point comes once, or at most once a tile of points, not once a block.
    assert tiles[0].groupBy("query_id").count().agg(F.max("count")).first()[0] <= 5 * -(-neighbours.build(points, "euclidean").size // 3)


def walk_by_hand(x, k, max_eps, xi):
    """Order, reachabilities and labels, one point after the other."""
    n = len(x)
    w = reach_matrix(x, k)
    reach, by, order, out = np.full(n, np.inf), [None] * n, [], []
    left = set(range(n))
    while left:
        open_ = [j for j in left if reach[j] < np.inf]
        now = min(open_, key=lambda j: (reach[j], *by[j])) if open_ else min(left)
        left.remove(now)
        order.append(now)
        out.append(reach[now])
        for j in left:
            edge = (w[now, j], min(now, j), max(now, j))
            if w[now, j] <= max_eps and (by[j] is None or edge < (reach[j], *by[j])):
                reach[j], by[j] = w[now, j], edge[1:]
    labels, start, c = [-1] * n, None, 0
    for i in range(n - 1):
        a, b = out[i], out[i + 1]
        stop = np.isinf(a) or np.isinf(b)
        if not stop and a * (1 - xi) >= b:
            start = i if start is None else start
        elif stop or a <= b * (1 - xi):
            if start is not None:
                for m in order[start : i + 1]:
                    labels[m] = c
                c, start = c + 1, None
    if start is not None:
        for m in order[start:]:
            labels[m] = c
    return order, out, labels


@pytest.mark.parametrize(("max_eps", "places"), [(1.2, 16)])
def test_optics_equals_walking_point_by_point(spark, monkeypatch, max_eps, places):
    monkeypatch.setattr(density, "PLACES", places)
    x = blobs(5, [25, 20], 2, 0.3, 8)
    order, out, labels = walk_by_hand(x, 3, max_eps, 0.2)
    got = density.optics(table(spark, x).union(spark.createDataFrame([(900, None)], "id long, v array<double>")), 3, max_eps, xi=0.2).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(len(x)))
    assert [r["id"] for r in got] == order
    assert np.allclose([r["reachability"] for r in got], out)
    assert {r["id"]: r["label"] for r in got} == dict(enumerate(labels))
    assert max_eps > 2 or sum(np.isinf(out)) > 2


def test_optics_of_few_points(spark):
    few = spark.createDataFrame([(5, [1.0]), (3, [1.5])], "id long, v array<double>")
    assert [(r["id"], r["place"], r["reachability"], r["core"]) for r in density.optics(few, 4).orderBy("place").collect()] == [(3, 0, float("inf"), float("inf")), (5, 1, float("inf"), float("inf"))]
    assert density.optics(few.where("id < 0"), 2).count() == 0


def test_bounds_of_long_vectors_leave_results_as_they_are(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(90, 16)), 1) + 1e4  # far from the origin: a product alone would lose the digits
    x[10:20], x[30] = x[10], x[31] + 1e-9
    d, ids = neighbours.distances(x, x, "euclidean"), rng.permutation(90)
    wholes = []
    real = neighbours.distances
    monkeypatch.setattr(neighbours, "distances", lambda *a: wholes.append(1) or real(*a))
    held = neighbours.Bounds(x, x, "euclidean")
    assert not wholes and (held.low <= d).all() and (d <= held.high).all()
    i, j, near = held.nearest(7, ids, np.full(90, np.inf))
    best = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :7]
    assert (i == np.repeat(np.arange(90), 7)).all() and (j == best.ravel()).all() and (near == np.take_along_axis(d, best, 1).ravel()).all()
