"""Clustering of point tables (id, v) and quality measures of labellings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.functions import vectors
from sparksci.operators import graph
from sparksci.operators.spatial import _distances, pdist, radius_join
from sparksci.operators.statistics import ranks
from sparksci.sources.tables import forget, stored


def nearest_center(v: Column, centers: list[list[float]]) -> Column:
    """Index of the nearest centre, the lowest on a tie; the centres are a parameter of bounded size."""
    each = F.array(*(F.struct(vectors.distance(v, F.array(*map(F.lit, c)), "sqeuclidean").alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centers)))
    return F.array_min(each)["i"]


def kmeans_predict(points: DataFrame, centers: list[list[float]]) -> DataFrame:
    return points.select("id", nearest_center(F.col("v"), centers).cast("long").alias("label"))


def _assigned_sums(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(label, n, total, inertia) of each partition: a map-side combine of whole vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, d = centers.shape
        n, total, inertia = np.zeros(k, np.int64), np.zeros((k, d)), np.zeros(k)
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                d2 = ((x[:, None, :] - centers) ** 2).sum(2) if len(x) * k * d < 1e8 else _distances(x, centers, "sqeuclidean")
                label = d2.argmin(1)
                np.add.at(n, label, 1)
                np.add.at(total, label, x)
                np.add.at(inertia, label, d2[np.arange(len(x)), label])
        yield pd.DataFrame({"label": np.arange(k), "n": n, "total": list(total), "inertia": inertia})

    return points.select("v").mapInPandas(run, "label long, n long, total array<double>, inertia double")


def kmeans(points: DataFrame, centers: list[list[float]], max_iter: int = 300, tol: float = 1e-4) -> tuple[list[list[float]], float, int]:
    """Lloyd's iterations from given centres: (centres, inertia, iterations). k rows a partition reach the driver each time.

    An empty cluster keeps its centre; stops when the inertia changes by less than ``tol``.
    """
    c, last, step = np.array(centers, float), None, 0
    for step in range(1, max_iter + 1):
        dims = F.array(*(F.sum(F.col("total")[j]) for j in range(c.shape[1])))
        rows = _assigned_sums(points, c).groupBy("label").agg(F.sum("n").alias("n"), dims.alias("total"), F.sum("inertia").alias("inertia")).collect()
        inertia = sum(r["inertia"] for r in rows)
        for r in rows:
            if r["n"]:
                c[r["label"]] = np.array(r["total"]) / r["n"]
        if last is not None and abs(last - inertia) < tol:
            break
        last = inertia
    return c.tolist(), float(inertia), step


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """(id, label): -1 for noise; clusters numbered by their least id. Links hold where either end is a core point."""
    pairs = stored(radius_join(points, points, eps, metric).select(F.col("query_id").alias("src"), F.col("id").alias("dst")))
    core = pairs.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("src").alias("core"))
    links = pairs.join(core, F.col("src") == F.col("core")).select("src", "dst", F.lit(1.0).alias("w"))
    member = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    found = graph.connected_components(links, member)
    names = ranks(found.select("component").distinct(), "component", out="label").withColumn("label", F.col("label") - 1)
    return points.select("id").join(found.join(names, "component"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"))


#: Points of a block, and blocks that a task takes from one side, about; sums that it holds before it gives them on.
BLOCK, SIDE, SUMS = 2048, 16, 1 << 21


def _label_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, label, other, d, n): distances of each point to a label's points, added up over the pairs of blocks (sorted by label) of a task."""
    held: dict[int, tuple] = {}

    def given() -> Iterator[pd.DataFrame]:
        for ids, labels, sums in held.values():
            for other, (d, n) in sums.items():
                yield pd.DataFrame({"id": ids, "label": labels, "other": other, "d": d, "n": n})
        held.clear()

    cells = 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            ids, labels, theirs = np.asarray(row.ids), np.asarray(row.labels), np.asarray(row.labels2)
            x, y = np.frombuffer(row.v).reshape(len(ids), -1), np.frombuffer(row.v2).reshape(len(theirs), -1)
            kinds, starts, counts = np.unique(theirs, return_index=True, return_counts=True)
            d = np.concatenate([np.add.reduceat(_distances(x[at : at + 64], y, "euclidean"), starts, axis=1) for at in range(0, len(x), 64)])
            sums = held.setdefault(row.block, (ids, labels, {}))[2]
            for k, other in enumerate(kinds):
                before = sums.get(other)
                cells += len(ids) if before is None else 0
                sums[other] = (d[:, k], int(counts[k])) if before is None else (before[0] + d[:, k], before[1] + int(counts[k]))
            if cells > SUMS:
                yield from given()
                cells = 0
    yield from given()


def silhouette_samples(points: DataFrame) -> DataFrame:
    """(id, label, silhouette) of rows (id, v, label). Blocks of points meet blocks; a task adds up what a block's points find in its other blocks.

    All pairs by definition; what is shuffled is points x labels x tasks a block meets.
    """
    whole = points.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v", F.col("label").cast("long").alias("label"))
    held = whole.count()
    n = max(1, -(-held // min(BLOCK, max(64, held // 16))))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("label")
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [pdf["id"].to_numpy()], "labels": [pdf["label"].to_numpy(np.int64)], "v": [v.tobytes()]})

    blocks = stored(whole.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("block").applyInPandas(pack, "block long, ids array<long>, labels array<long>, v binary"))
    others = blocks.select(F.col("labels").alias("labels2"), F.col("v").alias("v2")).repartition(max(1, -(-n // SIDE)))
    parts = blocks.repartition(n).crossJoin(others.hint("shuffle_replicate_nl")).mapInPandas(_label_sums, "id long, label long, other long, d double, n long")
    mean = stored(parts.groupBy("id", "label", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n")))
    forget(blocks)
    own = F.max(F.when(F.col("label") == F.col("other"), F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)).otherwise(0.0)))
    rest = F.min(F.when((F.col("label") != F.col("other")) & (F.col("other") >= 0), F.col("d") / F.col("n")))
    s = mean.groupBy("id", "label").agg(own.alias("a"), F.coalesce(rest, F.lit(0.0)).alias("b"))
    return s.select("id", "label", ((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-10))).alias("silhouette"))


def silhouette_score(points: DataFrame) -> DataFrame:
    return silhouette_samples(points).agg(F.avg("silhouette").alias("silhouette"))


def _centroids(points: DataFrame) -> DataFrame:
    """(label, dim, c, n): centroids in long form; dimensions aggregate in parallel."""
    long = points.select("label", F.posexplode("v").alias("dim", "x"))
    return long.groupBy("label", "dim").agg(F.avg("x").alias("c"), F.count("*").alias("n"), (F.var_pop("x") * F.count("*")).alias("ss"))


def calinski_harabasz_score(points: DataFrame) -> DataFrame:
    """Between- over within-cluster dispersion; k is the greatest label plus one."""
    c = _centroids(points)
    whole = c.groupBy("dim").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("m"))
    out = c.join(whole, "dim").agg(
        F.sum(F.col("n") * (F.col("c") - F.col("m")) ** 2).alias("between"), F.sum("ss").alias("within"), (F.max("label") + 1).alias("k"), F.sum(F.when(F.col("dim") == 0, F.col("n"))).alias("n")
    )
    k, n = F.col("k"), F.col("n")
    return out.select(((F.col("between") / (k - 1)) / (F.col("within") / (n - k))).alias("score"))


def davies_bouldin_score(points: DataFrame) -> DataFrame:
    """Mean over clusters of the worst ratio of scatter to separation; centroids (k rows) meet each other, points do not."""
    center = _centroids(points).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda p: p["c"]).alias("c"))
    spread = points.join(center, "label").groupBy("label").agg(F.avg(vectors.distance(F.col("v"), F.col("c"))).alias("s"))
    one = center.join(spread, "label")
    other = one.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    worst = one.join(other, F.col("label") != F.col("l2")).groupBy("label").agg(F.max((F.col("s") + F.col("s2")) / vectors.distance(F.col("c"), F.col("c2"))).alias("r"))
    return worst.agg(F.avg("r").alias("score"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand_score(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pair counting over the contingency table; 0 where both labellings have one cluster."""
    two = lambda n: n * (n - 1) / 2
    t = contingency(df, a, b)
    rows, cols = t.groupBy("a").agg(F.sum("n").alias("n")), t.groupBy("b").agg(F.sum("n").alias("n"))
    s = t.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("total")).crossJoin(rows.agg(F.sum(two(F.col("n"))).alias("x"))).crossJoin(cols.agg(F.sum(two(F.col("n"))).alias("y")))  # single rows
    expected = F.col("x") * F.col("y") / two(F.col("total"))
    most = (F.col("x") + F.col("y")) / 2
    return s.select(F.when(F.abs(most - expected) < 1e-15, 0.0).otherwise((F.col("s") - expected) / (most - expected)).alias("score"))


def _entropies(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ha, hb, mi) in nats. Windows run over the contingency table, labels x labels."""
    t = contingency(df, a, b)
    total = F.sum("n").over(Window.partitionBy())
    p = t.select((F.col("n") / total).alias("p"), (F.sum("n").over(Window.partitionBy("a")) / total).alias("pa"), (F.sum("n").over(Window.partitionBy("b")) / total).alias("pb"))
    return p.agg(F.sum(-F.col("p") * F.log("pa")).alias("ha"), F.sum(-F.col("p") * F.log("pb")).alias("hb"), F.sum(F.col("p") * F.log(F.col("p") / (F.col("pa") * F.col("pb")))).alias("mi"))


def normalized_mutual_info_score(df: DataFrame, a: str, b: str) -> DataFrame:
    return _entropies(df, a, b).select((2 * F.col("mi") / F.greatest(F.col("ha") + F.col("hb"), F.lit(1e-15))).alias("score"))


def homogeneity_completeness_v_measure(df: DataFrame, a: str, b: str) -> DataFrame:
    """a: true classes, b: predicted clusters."""
    e = _entropies(df, a, b)
    h = F.when(F.col("ha") < 1e-15, 1.0).otherwise(F.col("mi") / F.greatest("ha", F.lit(1e-15)))
    c = F.when(F.col("hb") < 1e-15, 1.0).otherwise(F.col("mi") / F.greatest("hb", F.lit(1e-15)))
    return e.select(h.alias("homogeneity"), c.alias("completeness"), (2 * h * c / F.greatest(h + c, F.lit(1e-15))).alias("v_measure"))


def single_linkage(points: DataFrame) -> DataFrame:
    """(step, a, b, distance): merges of single linkage, which are the edges of the minimum spanning tree in order of length.

    All pairs by definition: for point sets of bounded size; a and b are the points whose link merges their clusters.
    """
    pairs = pdist(points).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("distance").alias("w"))
    tree = graph.minimum_spanning_tree(pairs, points.select("id"))
    return ranks(tree.select("src", "dst", "w"), "w", tie=("src", "dst"), out="step").select("step", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("distance"))


def fcluster(points: DataFrame, merges: DataFrame, distance: float) -> DataFrame:
    """(id, label): clusters that remain when merges up to a distance are made; a label is the least id."""
    links = merges.where(F.col("distance") <= distance).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w"))
    return graph.connected_components(links, points.select("id")).select("id", F.col("component").alias("label"))
