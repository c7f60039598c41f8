"""A block index over point tables (id, v), and the searches that it prunes.

Points go to the nearest of a few pivots and, ring by ring around it, into blocks of
bounded size.  A block knows the least and greatest distance of its points to every
pivot, so the triangle inequality bounds the distance of two blocks without a look at
their points; pairs of cells are sorted out first, then pairs of blocks, then single
queries in the task.  Results are exact: pivots only decide how much is pruned.

Rows without id or vector, or with a null or NaN in it, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.sources.tables import forget, stored

#: Metrics with a triangle inequality.
METRICS = ("euclidean", "manhattan", "chebyshev")
#: Points a block holds, about; pivots and rings at most, and the rows that they are drawn from.
BLOCK, PIVOTS, RINGS, SAMPLE = 512, 128, 64, 2048
#: Where most blocks meet: blocks that a task takes of either side, and the numbers in those of one side, about.
TILE, NUMBERS = (16, 64), 1 << 21
BLOCKS = "block long, cell int, ids array<long>, vs array<array<double>>, lo array<double>, hi array<double>"


def row_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances along the last axis, each by differences first: the same pair gives the same bits everywhere."""
    d = a - b
    if metric == "euclidean":
        return np.sqrt((d * d).sum(-1))
    return np.abs(d).sum(-1) if metric == "manhattan" else np.abs(d).max(-1)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two sets of rows, in bounded memory."""
    step = max(1, (1 << 20) // max(1, x.size))
    return np.concatenate([row_distances(q[k : k + step, None, :], x[None], metric) for k in range(0, len(q), step)])


#: Components from which on euclidean distances are first bounded by a matrix product.
PRODUCT_FROM = 8


class Bounds:
    """Lower and upper bounds of all distances of two sets of rows, and the distances of chosen pairs.

    Long vectors get their bounds from a matrix product, many times faster than differences; what a bound leaves open
    is settled by differences, so results are those of ``row_distances`` to the bit.
    """

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        self.q, self.x, self.metric, self.exact = q, x, metric, True
        if metric == "euclidean" and q.shape[1] >= PRODUCT_FROM and len(q) and len(x):
            a, b = (q * q).sum(1), (x * x).sum(1)
            error = 16 * (q.shape[1] + 8) * np.finfo(float).eps * (a.max() + b.max())  # of both ways to add up squares, amply
            if np.isfinite(error):
                d2 = a[:, None] + b - 2 * (q @ x.T)
                self.low, self.high, self.exact = np.sqrt(np.maximum(0, d2 - error)), np.sqrt(np.maximum(0, d2) + error), False
        if self.exact:
            self.low = self.high = distances(q, x, metric)

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.exact:
            return self.low[i, j]
        step = max(1, (1 << 20) // self.q.shape[1])
        return np.concatenate([row_distances(self.q[i[k : k + step]], self.x[j[k : k + step]], self.metric) for k in range(0, max(1, len(i)), step)])

    def nearest(self, k: int, ids: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of each query's k nearest of those within its ``top``, in order; ties to the smaller id."""
        if k < len(self.x):
            top = np.minimum(top, np.partition(self.high, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero(self.low <= top[:, None])
        d = self.pairs(i, j)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[kept], j[kept], d[kept]


@dataclass
class Index:
    """Written blocks (block, cell, ids, vs, lo, hi) of one point table."""

    blocks: DataFrame
    pivots: np.ndarray
    metric: str
    size: int = 0

    def drop(self) -> None:
        forget(self.blocks)


def _spread(rows: list[list[float]], wanted: int, metric: str) -> np.ndarray:
    """Rows far from each other: each next one is the farthest from those before."""
    if not rows:
        return np.empty((0, 0))
    x = np.array(rows, float)
    chosen, far = [0], row_distances(x, x[0], metric)
    while len(chosen) < wanted and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, row_distances(x, x[chosen[-1]], metric))
    return x[chosen]


def build(points: DataFrame, metric: str = "euclidean", size: int = BLOCK, pivots: np.ndarray | None = None) -> Index:
    """Index a table; ``pivots`` of another index make the two comparable. Pivots come from SAMPLE rows, every row is indexed."""
    if metric not in METRICS:
        raise ValueError(f"metric is one of {', '.join(METRICS)}")
    spark = points.sparkSession
    whole = points.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select(F.col("id").cast("long").alias("id"), F.transform("v", lambda c: c.cast("double")).alias("v"))
    whole = whole.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    if pivots is None:
        sample = [r["v"] for r in whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
        pivots = _spread(sample, min(PIVOTS, max(4, math.ceil(2 * whole.count() / size))), metric)
    if not len(pivots):
        return Index(spark.createDataFrame([], BLOCKS), pivots, metric)
    drawn = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    if not drawn:
        return Index(spark.createDataFrame([], BLOCKS), pivots, metric)
    edges = np.quantile(distances(np.array([r["v"] for r in drawn], float), pivots, metric).min(1), np.arange(1, RINGS) / RINGS)

    def placed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = distances(np.stack(pdf["v"].to_numpy()), pivots, metric)
        cell = d.argmin(1)
        return d, cell, np.searchsorted(edges, d[np.arange(len(d)), cell])

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(pivots), RINGS), np.int64)
        for pdf in batches:
            if len(pdf):
                _, cell, ring = placed(pdf)
                np.add.at(held, (cell, ring), 1)
        cell, ring = np.nonzero(held)
        yield pd.DataFrame({"cell": cell, "ring": ring, "n": held[cell, ring]})

    held = np.zeros((len(pivots), RINGS), np.int64)  # pivots x rings at most
    for r in whole.select("v").mapInPandas(tally, "cell int, ring int, n long").groupBy("cell", "ring").agg(F.sum("n").alias("n")).collect():
        held[r["cell"], r["ring"]] = r["n"]
    first, parts, block = np.zeros_like(held), np.ones_like(held), 0
    for cell in range(len(held)):
        filled = 0
        for ring in range(RINGS):
            n = held[cell, ring]
            if filled and filled + n > size:
                block, filled = block + 1, 0
            first[cell, ring], parts[cell, ring] = block, max(1, -(-n // size))
            block, filled = block + parts[cell, ring] - 1, filled + n if parts[cell, ring] == 1 else size
        block += 1

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, cell, ring = placed(pdf)
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": cell, "block": first[cell, ring] + pdf["h"].to_numpy() % parts[cell, ring]})

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = distances(np.stack([p["v"] for p in row.p]), pivots, metric)
                yield pd.DataFrame({"block": [row.block], "cell": [row.cell], "ids": [[p["id"] for p in row.p]], "vs": [[p["v"] for p in row.p]], "lo": [d.min(0)], "hi": [d.max(0)]})

    dealt = whole.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 31))).mapInPandas(deal, "id long, v array<double>, cell int, block long")
    grouped = dealt.groupBy("block").agg(F.first("cell").alias("cell"), F.collect_list(F.struct("id", "v")).alias("p"))
    return Index(stored(grouped.mapInPandas(bound, BLOCKS)), pivots, metric, int(block))


def gap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """A lower bound of the distance of two blocks by all pivots."""
    away = lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: x - y))
    return F.greatest(F.lit(0.0), away(lo, hi2), away(lo2, hi))


def _cells(blocks: DataFrame, reach: bool = False) -> pd.DataFrame:
    """Bounds of whole cells: at most PIVOTS rows in the driver."""
    more = ", reach double" if reach else ""

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"cell": [pdf["cell"].iloc[0]], "lo": [np.stack(pdf["lo"].to_numpy()).min(0)], "hi": [np.stack(pdf["hi"].to_numpy()).max(0)]}
        return pd.DataFrame(out | ({"reach": [pdf["reach"].max()]} if reach else {}))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("cell"):
                yield whole(own)

    schema = "cell int, lo array<double>, hi array<double>" + more
    held = blocks.select("cell", "lo", "hi", *(["reach"] if reach else []))
    return held.mapInPandas(parts, schema).groupBy("cell").applyInPandas(whole, schema).toPandas()


def block_pairs(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(q_block, p_block, bound): pairs whose bound does not exceed the query block's ``reach``. Blocks of surviving cells meet by cell."""
    q_cells, p_cells = _cells(queries, True), _cells(points)
    spark = queries.sparkSession
    if not len(q_cells) or not len(p_cells):
        return spark.createDataFrame([], "q_block long, p_block long, bound double")
    qlo, qhi, plo, phi = (np.stack(c.to_numpy()) for c in (q_cells["lo"], q_cells["hi"], p_cells["lo"], p_cells["hi"]))
    apart = np.maximum((qlo[:, None] - phi[None]).max(2), (plo[None] - qhi[:, None]).max(2))
    i, j = np.nonzero(apart <= q_cells["reach"].to_numpy()[:, None])
    cells = spark.createDataFrame(pd.DataFrame({"q_cell": q_cells["cell"].to_numpy()[i], "p_cell": p_cells["cell"].to_numpy()[j]}))
    q = queries.select(F.col("block").alias("q_block"), F.col("cell").alias("q_cell"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), "reach")
    p = points.select(F.col("block").alias("p_block"), F.col("cell").alias("p_cell"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"))
    met = q.join(F.broadcast(cells), "q_cell").join(p, "p_cell").withColumn("bound", gap(F.col("q_lo"), F.col("q_hi"), F.col("p_lo"), F.col("p_hi")))
    return met.where(F.col("bound") <= F.col("reach")).select("q_block", "p_block", "bound")


def meet(pairs: DataFrame, queries: DataFrame, points: DataFrame, kernel: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, sizes: tuple[int, int] = (0, 0), combine: Callable | None = None) -> DataFrame:
    """Run ``kernel`` on each pair of blocks: columns q_* and p_* of the two tables beside the pair's own.

    Where ``sizes``, the numbers of blocks, allow more pairs than blocks of a tile, pairs are counted; if most blocks meet, they go
    by tiles. ``combine`` makes fewer rows of those that the kernel gives for one query block in a tile; rows may also come as they are.
    """
    q = queries.withColumnsRenamed({c: f"q_{c}" for c in queries.columns})
    p = points.withColumnsRenamed({c: f"p_{c}" for c in points.columns})
    if min(sizes) > TILE[0]:
        pairs = stored(pairs.select("q_block", "p_block"))
        if pairs.count() > TILE[0] * sum(sizes):
            return _tiled(pairs, q, p, kernel, schema, sizes, combine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield from kernel(row)

    # Pairs are few and small rows: left as they lie, or merged by their size, one task would search them all.
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, "q_block", "p_block").join(q, "q_block").join(p, "p_block").mapInPandas(run, schema)


def _tiled(pairs: DataFrame, q: DataFrame, p: DataFrame, kernel: Callable, schema: str, sizes: tuple[int, int], combine: Callable | None) -> DataFrame:
    """``meet`` by tiles: each block is shuffled once and each task reads a few blocks of both sides, so pairs move no vectors."""
    one = q.select((F.size("q_vs") * F.size(F.col("q_vs")[0])).alias("n")).agg(F.max("n")).first()[0]
    side = [max(1, min(t, NUMBERS // max(1, one))) for t in TILE]
    columns = {"q": q.columns, "p": p.columns}

    def tiles(blocks: DataFrame, name: str, per: int, n: int) -> DataFrame:
        held = blocks.groupBy(F.floor(F.col(f"{name}_block") / per).cast("int").alias(f"{name}_tile")).agg(F.collect_list(F.struct(*columns[name])).alias("b"))
        return held.select(f"{name}_tile", *(F.col(f"b.{c}").alias(c) for c in columns[name]))

    tile = F.floor(F.col("q_block") / side[0]).cast("int").alias("q_tile")
    asked = pairs.groupBy(tile).agg(F.collect_list(F.struct("q_block", "p_block")).alias("w")).select("q_tile", F.col("w.q_block").alias("asking"), F.col("w.p_block").alias("asked"))
    counts = [-(-n // per) for n, per in zip(sizes, side, strict=True)]
    left = tiles(q, "q", side[0], sizes[0]).join(asked, "q_tile").repartitionById(counts[0], F.col("q_tile"))
    right = tiles(p, "p", side[1], sizes[1]).repartitionById(counts[1], F.col("p_tile"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                mine = {name: [SimpleNamespace(**dict(zip(columns[name], own, strict=True))) for own in zip(*(getattr(row, c) for c in columns[name]), strict=True)] for name in "qp"}
                for block in (*mine["q"], *mine["p"]):
                    for c in ("q_vs", "p_vs"):
                        if hasattr(block, c):
                            setattr(block, c, np.stack(getattr(block, c)))
                asking, asked = np.asarray(row.asking), np.asarray(row.asked)
                for block in mine["q"]:
                    wanted = set(asked[asking == block.q_block].tolist())
                    found = (f for other in mine["p"] if other.p_block in wanted for f in kernel(SimpleNamespace(**vars(block), **vars(other))))
                    if combine is None:
                        yield from found
                    elif frames := [f for f in found if len(f)]:
                        yield combine(pd.concat(frames, ignore_index=True))

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInPandas(run, schema)


def _query_bounds(q: np.ndarray, pivots: np.ndarray, metric: str, lo, hi) -> np.ndarray:
    d = Bounds(q, pivots, metric)
    return np.maximum(0, np.maximum(np.asarray(lo) - d.high, d.low - np.asarray(hi)).max(1))


def radius_join(points: DataFrame, queries: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """(query_id, id, distance) within ``radius`` (inclusive); a point is its own neighbour."""
    p = build(points, metric)
    q = p if queries is points else build(queries, metric, pivots=p.pivots)
    pivots = p.pivots

    def within(row) -> Iterator[pd.DataFrame]:
        x, w = np.stack(row.q_vs), np.stack(row.p_vs)
        asked = np.flatnonzero(_query_bounds(x, pivots, metric, row.p_lo, row.p_hi) <= radius)
        if len(asked):
            held = Bounds(x[asked], w, metric)
            i, j = np.nonzero(held.low <= radius)
            d = held.pairs(i, j)
            i, j, d = i[d <= radius], j[d <= radius], d[d <= radius]
            yield pd.DataFrame({"query_id": np.asarray(row.q_ids)[asked[i]], "id": np.asarray(row.p_ids)[j], "distance": d})

    pairs = block_pairs(q.blocks.withColumn("reach", F.lit(float(radius))), p.blocks)
    return meet(pairs, q.blocks.drop("cell", "lo", "hi"), p.blocks.drop("cell"), within, "query_id long, id long, distance double", (q.size, p.size))


def first_reach(q: Index, p: Index, k: int) -> DataFrame:
    """(block, taus): per query an upper bound of its k-th distance, from the one block of its cell that lies nearest."""
    metric = p.metric
    near = q.blocks.select(F.col("block").alias("q_block"), "cell", F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi")).join(p.blocks.select(F.col("block").alias("p_block"), "cell", "lo", "hi", F.size("ids").alias("n")), "cell")
    away = F.struct((F.col("n") < k).alias("few"), gap(F.col("q_lo"), F.col("q_hi"), F.col("lo"), F.col("hi")).alias("bound"), F.col("p_block"))
    one = near.groupBy("q_block").agg(F.min(away).alias("m")).select("q_block", "m.p_block")

    def kth(row) -> Iterator[pd.DataFrame]:
        x, w = np.stack(row.q_vs), np.stack(row.p_vs)
        taus = Bounds(x, w, metric).nearest(k, np.arange(len(w)), np.full(len(x), np.inf))[2].reshape(len(x), k)[:, k - 1] if len(w) >= k else np.full(len(x), np.inf)
        yield pd.DataFrame({"block": [row.q_block], "taus": [taus]})

    return meet(one, q.blocks.select("block", "vs"), p.blocks.select("block", "vs"), kth, "block long, taus array<double>")


def knn(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest points of each query; ties to the smaller id; a point is its own neighbour.

    One block gives each query a bound of its k-th distance; only blocks within that bound are searched.
    """
    p = build(points, metric)
    q = p if queries is points else build(queries, metric, 256, p.pivots)
    pivots = p.pivots
    taus = stored(first_reach(q, p, k))
    asked = q.blocks.join(taus, "block", "left").withColumn("taus", F.coalesce("taus", F.transform("ids", lambda _: F.lit(float("inf")))))
    pairs = block_pairs(asked.withColumn("reach", F.array_max("taus")), p.blocks)

    def best(row) -> Iterator[pd.DataFrame]:
        x, w, ids, tau = np.stack(row.q_vs), np.stack(row.p_vs), np.asarray(row.p_ids), np.asarray(row.q_taus)
        at = np.flatnonzero(_query_bounds(x, pivots, metric, row.p_lo, row.p_hi) <= tau * (1 + 1e-12))
        if len(at):
            i, j, d = Bounds(x[at], w, metric).nearest(k, ids, tau[at])
            kept = d <= tau[at][i]
            yield pd.DataFrame({"query_id": np.asarray(row.q_ids)[at][i[kept]], "id": ids[j[kept]], "distance": d[kept]})

    def nearest(found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["query_id", "distance", "id"])
        return found[found.groupby("query_id").cumcount() < k]

    found = meet(pairs, asked.select("block", "ids", "vs", "taus"), p.blocks.drop("cell"), best, "query_id long, id long, distance double", (q.size, p.size), nearest)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def searched_share(pairs: DataFrame, queries: DataFrame, points: DataFrame) -> float:
    """The share of all (query, point) pairs that lie in the given block pairs."""
    size = lambda t: t.select("block", F.size("ids").alias("n"))
    met = pairs.join(size(queries).withColumnsRenamed({"block": "q_block", "n": "nq"}), "q_block").join(size(points).withColumnsRenamed({"block": "p_block", "n": "np"}), "p_block")
    total = [size(t).agg(F.sum("n")).first()[0] or 0 for t in (queries, points)]
    return (met.agg(F.sum(F.col("nq") * F.col("np"))).first()[0] or 0) / max(1, total[0] * total[1])
