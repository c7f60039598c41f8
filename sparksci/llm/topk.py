"""Exact top-k inner-product search over a pivot-distance index.

One more component makes all vectors equally long, so the largest inner product is the
least Euclidean distance.  Every vector is keyed by its nearest pivot and its distance
to it and stored, in that order, in blocks: sorted annuli around the pivots.  A first
round searches the annuli next to each query for a bound on its k-th score.  An annulus
knows its least and greatest distance to every pivot; by the triangle inequality only
annuli that reach into a query's radius as seen from all pivots can hold a better vector,
and the second round searches exactly these, query by query.  ``searched_share`` says
how many pairs are left: few where vectors lie in clusters, all where their distances
hardly differ.

Defined cases: vectors that are null or hold null or non-finite components, and rows
without id, take no part; shorter vectors count as padded with zeros; a query never
finds rows with its own id; equal scores go to the smaller id; fewer than k candidates
are all returned. Repeated rows: a query id is searched once, by the least of its
vectors; as candidates, all rows are rows of their own, so an id that two rows hold can
be found twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.llm.common import shares, table, written

#: Pivots: a bounded sample of the vectors, those with the least hashed ids.
PIVOTS = 64
BLOCK = 1024
QUERY_BLOCK = 128
HOME_BLOCKS = 2
SLACK = 1e-7


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with whole components floor(scale * x), of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fit).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _matrix(column: pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """A list column as a matrix, short vectors padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(sizes), dim), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Space:
    """The pivots, the longest length and the dimension: what every task needs, and of bounded size."""

    def __init__(self, pivots: np.ndarray, longest: float, dim: int, kind: str):
        self.pivots, self.longest, self.dim, self.kind = pivots, longest, dim, kind
        self.own = np.sqrt(np.maximum(0, longest - (pivots**2).sum(axis=1)))

    def distances(self, m: np.ndarray, query: bool) -> np.ndarray:
        """Of vectors (or queries, whose added component is zero) to each pivot."""
        norm = (m**2).sum(axis=1)
        added = 0.0 if query else np.sqrt(np.maximum(0, self.longest - norm))[:, None]
        if query:
            d2 = norm[:, None] + self.longest - 2 * m @ self.pivots.T
        else:
            d2 = 2 * self.longest - 2 * (m @ self.pivots.T + added * self.own)
        return np.sqrt(np.maximum(0, d2))


def _space(vectors: DataFrame, pivots: int) -> Space | None:
    norm = F.aggregate(F.transform("v", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    s = vectors.agg(F.max(norm).alias("longest"), F.max(F.size("v")).alias("dim"), F.max(most).alias("most")).first()
    if s["longest"] is None:
        return None
    chosen = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    m = np.zeros((len(chosen), s["dim"]))
    for k, v in enumerate(chosen):
        m[k, : len(v)] = v
    m = np.unique(m, axis=0)
    most = s["most"] or 0
    kind = "int16" if most < 2**15 else "int32" if most < 2**31 else "int64"
    return Space(m, s["longest"], s["dim"], kind)


def _keyed(vectors: DataFrame, space: Space, query: bool) -> DataFrame:
    """vec_id, v, its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                d = space.distances(_matrix(part.column(1), space.dim), query)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near], pa.float64())], names=["vec_id", "v", "pivot", "dist"]
                )

    return vectors.mapInArrow(run, "vec_id long, v array<long>, pivot int, dist double")


def _blocks(keyed: DataFrame, space: Space, size: int, rows: int, query: bool) -> DataFrame:
    """Sorted annuli: (block, pivot, near, far, lo, hi, ids, m), each of one pivot and at most ``size`` vectors.

    lo and hi are the bounds of the distances to every pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            pivot, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            cuts = np.r_[0, np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for at in range(a, b, size):
                    end = min(b, at + size)
                    own = batch.slice(at, end - at)
                    m = _matrix(own.column(1), space.dim, space.kind)
                    away = space.distances(m.astype(np.float64), query)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number], pa.int64()),
                            pa.array([int(pivot[at])], pa.int32()),
                            pa.array([float(dist[at])]),
                            pa.array([float(dist[end - 1])]),
                            pa.array([away.min(axis=0)], pa.list_(pa.float64())),
                            pa.array([away.max(axis=0)], pa.list_(pa.float64())),
                            pa.array([own.column(0).to_numpy()], pa.list_(pa.int64())),
                            pa.array([m.tobytes()], pa.binary()),
                        ],
                        names=["block", "pivot", "near", "far", "lo", "hi", "ids", "m"],
                    )
                    number += 1

    parts = shares(rows, 16 * size)
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
    return ordered.mapInArrow(run, "block long, pivot int, near double, far double, lo array<double>, hi array<double>, ids array<long>, m binary")


def _best(q_ids, q, ids, m, k):
    """The k best of a block for each query of a block: rows (query, id, score)."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, q.shape[1]) < 2.0**53
    scores = (m.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64) if exact else m.astype(np.int64) @ q.T.astype(np.int64)
    out = []
    for j, own in enumerate(q_ids.tolist()):
        s, some = scores[:, j], np.flatnonzero(ids != own)
        if len(some) > k:
            s_some = s[some]
            some = some[s_some >= np.partition(s_some, len(some) - k)[len(some) - k]]
        some = some[np.lexsort((ids[some], -s[some]))[:k]]
        out.append((np.full(len(some), own, np.int64), ids[some], s[some]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3


def _search(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, space: Space, k: int) -> DataFrame:
    """The k best rows of each query over the given pairs of blocks, but of queries that cannot find better ones in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q_ids, ids, lo, hi, radius = (batch.column(c)[at].values.to_numpy() for c in (0, 2, 4, 5, 6))
                q, m = (np.frombuffer(batch.column(c)[at].as_py(), space.kind).reshape(-1, space.dim) for c in (1, 3))
                d = space.distances(q.astype(np.float64), True)
                may = np.maximum(lo - d, d - hi).max(axis=1) <= radius + SLACK * (1 + d.max(initial=0) + math.sqrt(space.longest))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _best(q_ids[may], q[may], ids, m, k)], names=["query_id", "vec_id", "score"])

    met = pairs.join(queries.select("q_block", "q_ids", "q", "radius"), "q_block").join(blocks.select("block", "ids", "m", "lo", "hi"), "block").select("q_ids", "q", "ids", "m", "lo", "hi", "radius")
    return met.mapInArrow(run, "query_id long, vec_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Plan:
    """Both rounds: blocks, query blocks, the pairs searched first with what they find, and the pairs left to search."""

    def __init__(self, df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: int, pivots: int):
        vectors = written(quantised(df, id_col, vector_col, scale), "topk-vectors")
        self.space = space = _space(vectors, pivots)
        if space is None:
            return
        asked = vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
        self.blocks = written(_blocks(_keyed(vectors, space, False), space, BLOCK, vectors.count(), False), "topk-blocks")
        queries = _blocks(_keyed(asked, space, True), space, QUERY_BLOCK, asked.count(), True)
        queries = written(queries.selectExpr("block AS q_block", "pivot", "near AS q_near", "far AS q_far", "ids AS q_ids", "m AS q"), "topk-queries")
        rings = self.blocks.select("block", "pivot", "near", "far", "lo", "hi")
        # Round 1: the annuli around each query block's own pivot that come nearest to its distances.
        gap = F.greatest(F.lit(0.0), F.col("q_near") - F.col("far"), F.col("near") - F.col("q_far"))
        close = Window.partitionBy("q_block").orderBy("gap", "block")
        home = queries.select("q_block", "pivot", "q_near", "q_far").join(rings, "pivot").withColumn("gap", gap)
        home = home.withColumn("n", F.row_number().over(close)).where(F.col("n") <= HOME_BLOCKS).select("q_block", "block")
        unbounded = queries.withColumn("radius", F.transform("q_ids", lambda _: F.lit(math.inf)))
        self.first = written(_ranked(_search(home, unbounded, self.blocks, space, k), k), "topk-first")
        bound = self.first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        members = queries.select("q_block", F.explode("q_ids").alias("query_id"))
        grouped = members.join(bound, "query_id").groupBy("q_block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "least"))).alias("least"))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """For each query the radius within which a better vector may lie; for each query block and pivot the distances that this allows."""
            for batch in batches:
                for at in range(batch.num_rows):
                    ids = batch.column(1)[at].values.to_numpy()
                    q = np.frombuffer(batch.column(2)[at].as_py(), space.kind).reshape(-1, space.dim).astype(np.float64)
                    known = dict(batch.column(3)[at].as_py() or [])
                    least = np.array([known.get(i, -math.inf) for i in ids.tolist()])
                    d = space.distances(q, True)
                    radius = np.sqrt(np.maximum(0, (q**2).sum(axis=1) + space.longest - 2 * least))
                    slack = SLACK * (1 + d.max() + math.sqrt(space.longest))
                    low, high = (d - radius[:, None]).min(axis=0) - slack, (d + radius[:, None]).max(axis=0) + slack
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), *(pa.array([c], pa.list_(pa.float64())) for c in (radius, low, high))], names=["q_block", "radius", "low", "high"])

        wide = queries.join(grouped, "q_block", "left").select("q_block", "q_ids", "q", "least").mapInArrow(reach, "q_block long, radius array<double>, low array<double>, high array<double>")
        wide = written(wide, "topk-reach")
        self.queries = queries.join(wide.select("q_block", "radius"), "q_block")
        # An annulus is met through its own pivot; then all pivots must allow it.
        through = wide.select("q_block", "low", "high", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "own"))
        met = through.join(rings, "pivot").where((F.col("far") >= F.col("own.low")) & (F.col("near") <= F.col("own.high")))
        beyond = F.exists(F.zip_with("hi", "low", lambda x, y: x < y), lambda x: x) | F.exists(F.zip_with("lo", "high", lambda x, y: x > y), lambda x: x)
        self.pairs = met.where(~beyond).select("q_block", "block").join(home, ["q_block", "block"], "left_anti")
        self.home = home


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k largest inner products over all other rows."""
    plan = Plan(df, is_query, k, id_col, vector_col, scale, pivots)
    if plan.space is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    second = _search(plan.pairs, plan.queries, plan.blocks, plan.space, k)
    return _ranked(second.unionByName(plan.first.drop("rank")), k).select("query_id", "rank", "vec_id", "score")


def searched_share(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS) -> float:
    """The share of all (query, vector) pairs that lie in the blocks which both rounds search."""
    plan = Plan(df, is_query, k, id_col, vector_col, scale, pivots)
    if plan.space is None:
        return 0.0
    nq, nv = plan.queries.select("q_block", F.size("q_ids").alias("nq")), plan.blocks.select("block", F.size("ids").alias("nv"))
    met = plan.pairs.union(plan.home).join(nq, "q_block").join(nv, "block").agg(F.sum(F.col("nq") * F.col("nv"))).first()[0] or 0
    total = (nq.agg(F.sum("nq")).first()[0] or 0) * (nv.agg(F.sum("nv")).first()[0] or 0)
    return met / total if total else 0.0


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every hundredth embedding among all others."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, e.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM e q JOIN e ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
