"""Linkages against one merge at a time."""

import random

import numpy as np
import pandas as pd
import pytest

from sparksci.operators import cluster, linkage

METHODS = linkage.METHODS


def by_hand(d, method):
    """Merges (a, b, distance, size) of clusters named by least ids; distances from all points' pairs where the definition allows it."""
    groups, level, out = {max(g): g for g in ({i} for i in range(len(d)))}, {}, []
    dist = {(i, j): d[i][j] for i in groups for j in groups if i < j}
    while len(groups) > 1:
        at, a, b = min((v, i, j) for (i, j), v in dist.items())
        ga, gb = groups.pop(a), groups.pop(b)
        height = max(at, level.get(a, 0), level.get(b, 0))
        out.append((min(min(ga), min(gb)), max(min(ga), min(gb)), height, len(ga | gb)))
        for k, g in groups.items():
            x, y = dist.pop((min(a, k), max(a, k))), dist.pop((min(b, k), max(b, k)))
            new = {
                "single": min(x, y), "complete": max(d[i][j] for i in ga | gb for j in g), "weighted": (x + y) / 2,
                "average": np.mean([d[i][j] for i in ga | gb for j in g]),
                "ward": np.sqrt(((len(ga) + len(g)) * x * x + (len(gb) + len(g)) * y * y - len(g) * at * at) / (len(ga) + len(gb) + len(g))),
            }[method]
            dist[min(b, k), max(b, k)] = new
        del dist[a, b]
        groups[b], level[b] = ga | gb, height
    return out


def rows(df):
    return [(r["a"], r["b"], r["distance"], r["size"]) for r in df.orderBy("step").collect()]


def check_numbers(found, n):
    """Nodes number points, then merges; each is joined once, and sizes add up."""
    size = dict.fromkeys(range(n), 1)
    for r in found:
        assert r["left"] < r["right"] and r["size_left"] == size[r["left"]]
        size[n - 1 + r["step"]] = size.pop(r["left"]) + size.pop(r["right"])
        assert r["size"] == size[n - 1 + r["step"]]
    assert list(size.values()) == [n]


@pytest.mark.parametrize("method", METHODS)
def test_merges_equal_one_at_a_time(spark, method):
    rng = random.Random(5)
    x = np.array([[rng.gauss(c % 3 * 4, 1), rng.gauss(c % 2 * 5, 1)] for c in range(24)])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = by_hand(d.tolist(), method)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [1.0, float("nan")]), (None, [1.0, 2.0])], "id long, v array<double>")
    for finish in (8, 1024):  # rounds first, and one task alone
        merges = linkage.linkage_from_data(points, method, finish=finish)
        got = merges.orderBy("step").collect()
        assert [(r["a"], r["b"], r["size"]) for r in got] == [(a, b, s) for a, b, _, s in want]
        assert [r["distance"] for r in got] == pytest.approx([h for _, _, h, _ in want])
        check_numbers(got, len(x))


def test_ties_merge_alike_in_rounds_and_one_at_a_time(spark):
    rng = random.Random(8)
    n = 14
    d = [[0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i):
            d[i][j] = d[j][i] = float(rng.randrange(1, 4))
    pairs = spark.createDataFrame([(j, i, d[i][j]) for i in range(n) for j in range(i)] + [(3, 3, 0.0)], "i long, j long, distance double")
    ids = spark.range(n)
    for method in ("single", "complete"):
        want = sorted(by_hand(d, method), key=lambda m: m[2])
        for finish in (4, 1024):
            got = linkage.linkage(pairs, ids, method, finish)
            assert sorted(rows(got)) == sorted(want)
            check_numbers(got.orderBy("step").collect(), n)


def test_cuts_and_leaves(spark):
    points = spark.createDataFrame([(10, [0.0]), (20, [1.0]), (30, [9.0]), (40, [10.5]), (50, [30.0])], "id long, v array<double>")
    merges = linkage.linkage_from_data(points, "average", finish=1)
    cut = {(r["clusters"], r["id"]): r["label"] for r in linkage.cut_tree(points, merges, [1, 2, 3, 9]).collect()}
    assert [cut[3, i] for i in (10, 20, 30, 40, 50)] == [10, 10, 30, 30, 50]
    assert [cut[2, i] for i in (10, 20, 30, 40, 50)] == [10, 10, 10, 10, 50]
    assert {cut[1, i] for i in (10, 50)} == {10} and cut[9, 20] == 20
    assert {r["id"]: r["label"] for r in cluster.fcluster(points, merges, 1.2).collect()} == {10: 10, 20: 10, 30: 30, 40: 40, 50: 50}
    # Nodes: 0..4 points, 5 = {10, 20}, 6 = {30, 40}, 7 = {5, 6}, 8 = {4, 7}, so the far point comes first.
    leaves = linkage.leaves_list(points, merges).orderBy("place").collect()
    assert [(r["place"], r["id"]) for r in leaves] == [(0, 50), (1, 10), (2, 20), (3, 30), (4, 40)]


def test_no_merge_and_missing_pairs(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [2.0])], "id long, v array<double>")
    assert linkage.linkage_from_data(points.where("id = 1")).count() == 0
    assert linkage.linkage_from_data(points.where("id < 0")).count() == 0
    assert [r["id"] for r in linkage.leaves_list(points.where("id = 1"), linkage.linkage_from_data(points.where("id = 1"))).collect()] == [1]
    pairs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "i long, j long, distance double")
    for bad in (pairs, pairs.union(spark.createDataFrame([(1, 3, float("inf"))], pairs.schema)), pairs.union(pairs.where("i = 1"))):
        with pytest.raises(ValueError, match="one finite distance"):
            linkage.linkage(bad, points)
    with pytest.raises(ValueError, match="one of"):
        linkage.linkage(pairs, points, "nearest")
    with pytest.raises(ValueError, match="Euclidean"):
        linkage.linkage_from_data(points, "ward", "manhattan")


@pytest.mark.parametrize("method", METHODS)
def test_points_are_merged_without_a_table_of_pairs(spark, monkeypatch, method):
    """Copies, clusters that are split over blocks and several blocks a side; no pair of points is written."""

    def never(*_):
        raise AssertionError("a table of all pairs")

    monkeypatch.setattr(linkage, "pdist", never)
    monkeypatch.setattr(linkage, "BLOCK", 8)
    monkeypatch.setattr(linkage, "SIDE", 2)
    rng = random.Random(11)
    x = [[rng.gauss(c % 3 * 6, 1), rng.gauss(0, 1), *(rng.gauss(0, 0.1) for _ in range(7))] for c in range(20)]
    x = np.array(x + [x[4]] * 3)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    merges = linkage.linkage_from_data(points, method, finish=3)
    got = merges.orderBy("step").collect()
    want = by_hand(d.tolist(), method)
    assert sorted((r["a"], r["b"], r["size"]) for r in got) == sorted((a, b, s) for a, b, _, s in want)
    assert sorted(r["distance"] for r in got) == pytest.approx(sorted(h for _, _, h, _ in want))
    check_numbers(got, len(x))


def test_doubled_ids_and_infinite_vectors_raise(spark):
    for second in ([(1, [3.0])], [(2, [float("inf")])]):
        points = spark.createDataFrame([(1, [0.0]), *second], "id long, v array<double>")
        with pytest.raises(ValueError, match="one finite distance"):
            linkage.linkage_from_data(points)


@pytest.mark.parametrize("method", ["average", "complete", "single", "ward"])
def test_blocks_meet_in_arrays_that_are_made_once(monkeypatch, method):
    """Clusters of one to 150 rows over many parts, two rows that nearly coincide: nearest clusters as by all distances."""
    rng = np.random.default_rng(3)
    made, keep = [], linkage.RowDistances
    monkeypatch.setattr(linkage, "RowDistances", lambda *a: made.append(keep(*a)) or made[-1])

    def block(n, first, sizes):
        starts = np.arange(n) if method == "ward" else np.cumsum([0, *sizes])
        w = rng.integers(1, 4, n).astype(float) if method == "ward" else 1 / np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n]))
        return {"ids": first + np.arange(len(starts)), "starts": starts, "split": np.zeros(len(starts), bool), "w": w, "v": rng.normal(size=(n, 5))}

    q, t = block(300, 0, [1, 2, 150, 3, 60, 1, 1]), block(200, 1000, [2] * 20 + [1] * 30)
    t["v"][7] = q["v"][11] + 1e-9
    names = {**q, **{f"{k}2": c for k, c in t.items()}}
    row = pd.DataFrame({k: [c.tobytes() if k.rstrip("2") in "wv" else c] for k, c in names.items()})
    got = pd.concat(list(linkage._meeting(method, "euclidean", False)(iter([row]))))
    assert len(made) == 1
    d = np.sqrt(((q["v"][:, None] - t["v"]) ** 2).sum(-1))
    if method == "ward":
        d *= np.sqrt(2 * q["w"][:, None] * t["w"] / (q["w"][:, None] + t["w"]))
    else:
        whole = {"average": np.mean, "complete": np.max, "single": np.min}[method]
        d = np.array([[whole(d[a:b, e:f]) for e, f in zip(t["starts"], [*t["starts"][1:], 200], strict=True)] for a, b in zip(q["starts"], [*q["starts"][1:], 300], strict=True)])
    assert got["q"].tolist() == q["ids"].tolist() and got["t"].tolist() == t["ids"][d.argmin(1)].tolist()
    assert np.allclose(got["d"], d.min(1), rtol=1e-9, atol=0)
