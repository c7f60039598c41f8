"""What must not grow with the table: broadcasts of iterations, products that are shuffled."""

import numpy as np
from pyspark.sql import functions as F

from sparksci.functions import vectors
from sparksci.operators import graph, matrix


def test_components_send_no_labels_through_the_driver(spark, monkeypatch):
    plans = []

    def settled(df, keep=graph.settled):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(graph, "settled", settled)
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.connected_components(edges, spark.range(41).select("id")).collect()}
    assert got == {k: k // 10 * 10 for k in range(41)}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_products_of_neighbouring_columns_are_added_before_the_shuffle(spark):
    """8 blocks of 50 columns, each block with 16 cells: a task has few blocks, so few partial sums are shuffled."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        column = F.floor(F.col("id") / 4)
        a = spark.range(1600).select((F.col("id") % 4 + 4 * F.floor(column / 50)).alias("i"), column.alias("j"), F.lit(1.0).alias("v"))
        old = set(stages())
        got = {(r["i"], r["j"]): r["v"] for r in matrix.multiply(a, matrix.transpose(a)).collect()}
        moved = sum(n for k, n in stages().items() if k not in old)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {(i, j): 50.0 for i in range(32) for j in range(i // 4 * 4, i // 4 * 4 + 4)}
    assert 3200 <= moved < 3200 + 400


def test_product_of_gaps_and_nulls(spark):
    a = spark.createDataFrame([(0, 1, 2.0), (0, 2, None), (1, 5, 3.0), (2, None, 1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(1, 7, 4.0), (2, 8, 1.0), (2, 7, 1.0), (6, 7, 1.0), (None, 7, 1.0)], "i long, j long, v double")
    assert {(r["i"], r["j"]): r["v"] for r in matrix.multiply(a, b).collect()} == {(0, 7): 8.0, (0, 8): None}


def test_euler_turns_are_products_with_few_steps(spark):
    """Equal to products of turns about axes, with one normalisation in all."""
    axes = {"X": (1, 0, 0), "Y": (0, 1, 0), "Z": (0, 0, 1)}
    one = spark.createDataFrame([(0.3, -1.2, 2.5)], "a double, b double, c double")
    for order in ("XYZ", "ZYX", "ZXZ", "YYX"):
        plain = None
        for axis, angle in zip(order, "abc", strict=True):
            turn = vectors.quat_from_axis_angle(*(F.lit(float(k)) for k in axes[axis]), F.col(angle))
            plain = turn if plain is None else vectors.quat_multiply(turn, plain)
        got = one.select(vectors.quat_from_euler(order, F.col("a"), F.col("b"), F.col("c")).alias("q"), plain.alias("p"))
        row = got.first()
        assert all(abs(row["q"][k] - row["p"][k]) < 1e-12 for k in "wxyz"), order
    plan = one.select(vectors.quat_from_euler("XYZ", F.col("a"), F.col("b"), F.col("c")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("transform(") <= 4


def test_eigenvector_query_is_not_cut_after_few_passes(spark, sf, monkeypatch):
    """A graph of two sides swings between two vectors; passes that are not made change nothing, for an even and an odd number of them."""
    from sparksci.plans import QUERIES
    from sparksci.plans import graph as plans

    a = np.zeros((5, 5))
    for i, j in ((0, 1), (0, 2), (0, 3), (3, 4)):
        a[i, j] = a[j, i] = 1.0
    edges = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")
    monkeypatch.setattr(plans, "supply", lambda *_: edges)
    x = [np.ones(5) / 5**0.5]
    for _ in range(100):
        x.append(a @ x[-1] / np.linalg.norm(a @ x[-1]))
    for got, want in ((QUERIES["eigenvector_centrality"](spark, sf), x[100]), (graph.eigenvector_centrality(edges, graph.nodes_of(edges), 99), x[99])):
        assert np.allclose([r["centrality"] for r in got.orderBy("id").collect()], want, rtol=0, atol=6e-5)
    assert np.abs(x[8] - x[100]).max() > 6e-5 and np.abs(x[99] - x[100]).max() > 0.01


def test_distances_to_queries_are_computed_by_blocks(spark, monkeypatch):
    """Two blocks of vectors, and rows that fit in none: each pair once, with the distance of its own two vectors."""
    from sparksci.operators import spatial

    monkeypatch.setattr(spatial, "BLOCK", 8)
    rows = [(k, [float(k % 5), k / 3, -1.0]) for k in range(12)] + [(20, None), (21, [1.0, None, 2.0]), (22, [0.0, 0.0, 0.0]), (23, [float("inf"), 1.0, 1.0]), (24, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    for metric in ("euclidean", "cosine"):
        points = points if metric == "euclidean" else points.where("id IS NULL OR id <> 22")  # zero under cosine: raises as before
        queries = points.where("id IS NULL OR id % 2 = 0")
        q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        plain = points.crossJoin(q).select("query_id", "id", vectors.distance(F.col("q"), F.col("v"), metric).alias("distance"))
        held = spatial.cdist(points, queries, metric)
        assert "MapInPandas" in held._jdf.queryExecution().executedPlan().toString()
        got, want = (sorted(((r[0] or -1, r[1] or -1, None if r[2] is None else round(r[2], 6) + 0.0) for r in df.collect()), key=repr) for df in (held, plain))
        assert repr(got) == repr(want)
