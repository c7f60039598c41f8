"""Sharding by longest-processing-time scheduling of groups that stay together.

Groups (here: equal texts) are sorted by size and each goes to the least-loaded
shard of a heap.  Groups of one size are interchangeable, so the heap runs over the
distinct sizes with the number of groups of each, and the groups of a size are cut by
rank.  The sizes are distinct whole numbers whose sum is at most the bytes of the
table, so the driver sees at most sqrt(2 * bytes) of them, and one more for each part;
its work is a few steps for each, not one for each group.

Defined cases: null text is a text of no bytes and groups with the empty text;
repeated rows keep a row each; an empty table gives no rows; equal loads go to the
smaller shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import byte_length, discard, shares, table, written

GROUPS_A_PART = 500_000


def lpt(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """How many groups of each size go to each shard, {size: counts}, from (size, groups).

    While a size lasts, shard k takes groups at the loads L(k), L(k) + size, L(k) + 2 size, ...; the heap takes
    these loads in ascending order over all shards. How many lie below a level is arithmetic, so all groups that
    surely come first are dealt at once, by the highest level that does not use them up, and the heap deals the
    last ones. The work is a few steps a size, however many groups it has and however unequal the loads are.
    """
    heap = [(0, k) for k in range(shards)]
    dealt = {}
    for weight, n in sorted(sizes, reverse=True):
        counts = [0] * shards
        if n > 2 * shards:
            below = lambda level: [max(0, -(-(level - load) // weight)) for load, _ in heap]  # noqa: B023, E731
            low, high = heap[0][0], heap[0][0] + n * weight  # the least loaded shard alone could take all
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
            taken = below(low)
            for (_, k), m in zip(heap, taken, strict=True):
                counts[k] += m
            heap = [(load + m * weight, k) for (load, k), m in zip(heap, taken, strict=True)]
            heapq.heapify(heap)
            n -= sum(taken)
        for _ in range(n):
            load, k = heap[0]
            heapq.heapreplace(heap, (load + weight, k))
            counts[k] += 1
        dealt[weight] = counts
    return dealt


def _cuts(cells: list[tuple[int, int, int]], shards: int) -> pa.Table:
    """For each (size, part) of the sorted groups with its number of groups: after which rank each shard's share ends."""
    held: dict[int, int] = {}
    for size, _, n in cells:
        held[size] = held.get(size, 0) + n
    left = lpt(list(held.items()), shards)
    ends = np.empty((len(cells), shards), np.int64)
    for row, (size, _, n) in enumerate(cells):
        taken, rest = 0, left[size]
        for k in range(shards):
            take = min(n - taken, rest[k])
            rest[k] -= take
            taken += take
            ends[row, k] = taken
    size, part = (pa.array([c[i] for c in cells], kind) for i, kind in ((0, pa.int64()), (1, pa.int32())))
    return pa.table([size, part, pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * shards, ends.ravel())], names=["weight", "part", "cuts"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the groups of a sorted partition within each size, in order."""
    last, seen = None, 0
    for batch in batches:
        c = batch.column(1).to_numpy()
        if not len(c):
            continue
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        place = np.arange(len(c)) - np.repeat(starts, np.diff(np.r_[starts, len(c)]))
        if c[0] == last:
            place[: starts[1] if len(starts) > 1 else len(c)] += seen
        last, seen = c[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a partition within each shard."""
    seen: dict[int, int] = {}
    for batch in batches:
        shard = batch.column(3).to_numpy()
        at = np.empty(len(shard), np.int64)
        for k in np.unique(shard).tolist():
            own = np.flatnonzero(shard == k)
            at[own] = np.arange(len(own)) + seen.get(k, 0)
            seen[k] = seen.get(k, 0) + len(own)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "at"])


def shard_by_size(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and a gapless slot within the shard for every row of df."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), (byte_length(F.col(text_col)) + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("grp")
    )
    groups = rows.groupBy("grp").agg(F.sum("size").alias("weight"))
    total = df.count()
    parts = shares(total, GROUPS_A_PART, groups.sparkSession.sparkContext.defaultParallelism)
    ranked = (
        groups.repartitionByRange(parts, F.desc("weight"), "grp")
        .sortWithinPartitions(F.desc("weight"), "grp")
        .mapInArrow(_ranked, "grp binary, weight long, place long")
        .withColumn("part", F.spark_partition_id())
    )
    ranked = written(ranked, "shard-groups")
    # A size lies in neighbouring parts of the range, so there are at most sizes + parts cells.
    cells = ranked.groupBy("weight", "part").agg(F.count("*").alias("n")).toArrow()
    cells = sorted(zip(*(cells.column(c).to_pylist() for c in ("weight", "part", "n")), strict=True))
    spark = df.sparkSession
    limits = spark.createDataFrame(_cuts(cells, shards), "weight long, part int, cuts array<long>")
    placed = ranked.join(limits, ["weight", "part"]).select("grp", F.size(F.filter("cuts", lambda x: x <= F.col("place"))).alias("shard"))
    sharded = rows.join(placed, "grp").select("doc_id", "size", "text_crc32", "shard")
    numbered = written(sharded.mapInArrow(_numbered, "doc_id long, size long, text_crc32 long, shard int, at long").withColumn("part", F.spark_partition_id()), "shard-rows")
    discard(ranked)
    # One row for each part and shard; the running sums number the slots without gaps.
    counts = sorted(tuple(r) for r in numbered.groupBy("part", "shard").count().collect())
    begun, offsets = [0] * shards, []
    for part, k, n in counts:
        offsets.append((part, k, begun[k]))
        begun[k] += n
    starts = spark.createDataFrame(offsets, "part int, shard int, start long")
    return numbered.join(starts, ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; equal texts share a shard."""
    out = shard_by_size(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
