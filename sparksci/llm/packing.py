"""Best-fit packing of documents into fixed-size sequences under conflicts.

Bins are kept in order of their residual room, with a bitmap of the sources and a
bitmap of the duplicate clusters that they hold.  A piece looks up the first bin with
enough room and goes on to its successors until one holds neither its source nor its
cluster: the tightest compatible bin.  Rows are dealt to independent tasks by a hash
of their id, so a hot source or cluster is spread evenly and memory is bounded.

Defined cases: a document longer than a bin is cut into full pieces and a rest, and
nothing is lost; documents without words get a row with a null bin; null sources and
clusters conflict with nothing; equal lengths are taken in order of id, those of rows
without id last; repeated rows are documents of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import ascii_lower, shares, table, words

CAPACITY = 2048
DOCS_A_TASK = 2000


class Bins:
    """Open bins in order of residual room; ties by age."""

    def __init__(self, capacity: int, sources: int, clusters: int):
        self.capacity, self.made = capacity, 0
        self.room = np.empty(0, np.int64)
        self.bin = np.empty(0, np.int64)
        self.source = np.empty((0, sources // 64 + 1), np.uint64)
        self.cluster = np.empty((0, clusters // 64 + 1), np.uint64)

    def _place(self, room: int, number: int, source: np.ndarray, cluster: np.ndarray) -> None:
        at = int(np.searchsorted(self.room, room, side="right"))
        self.room = np.insert(self.room, at, room)
        self.bin = np.insert(self.bin, at, number)
        self.source = np.insert(self.source, at, source, axis=0)
        self.cluster = np.insert(self.cluster, at, cluster, axis=0)

    def _take(self, at: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        out = int(self.room[at]), int(self.bin[at]), self.source[at].copy(), self.cluster[at].copy()
        self.room, self.bin = np.delete(self.room, at), np.delete(self.bin, at)
        self.source, self.cluster = np.delete(self.source, at, axis=0), np.delete(self.cluster, at, axis=0)
        return out

    def tightest(self, size: int, source: int, cluster: int) -> int:
        """Index of the tightest compatible bin, -1 if none: successors are tried in runs that double."""
        at, run, n = int(np.searchsorted(self.room, size)), 16, len(self.room)
        while at < n:
            some = slice(at, min(n, at + run))
            clash = np.zeros(some.stop - at, bool)
            if source >= 0:
                clash |= self.source[some, source // 64] >> np.uint64(source % 64) & np.uint64(1) > 0
            if cluster >= 0:
                clash |= self.cluster[some, cluster // 64] >> np.uint64(cluster % 64) & np.uint64(1) > 0
            free = np.flatnonzero(~clash)
            if len(free):
                return at + int(free[0])
            at, run = some.stop, 2 * run
        return -1

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin number and offset of a piece."""
        at = self.tightest(size, source, cluster)
        if at < 0:
            room, number = self.capacity, self.made
            sources, clusters = np.zeros(self.source.shape[1], np.uint64), np.zeros(self.cluster.shape[1], np.uint64)
            self.made += 1
        else:
            room, number, sources, clusters = self._take(at)
        if source >= 0:
            sources[source // 64] |= np.uint64(1) << np.uint64(source % 64)
        if cluster >= 0:
            clusters[cluster // 64] |= np.uint64(1) << np.uint64(cluster % 64)
        if room > size:  # a full bin takes no more
            self._place(room - size, number, sources, clusters)
        return number, self.capacity - room


def pack_pieces(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces in the given order; sources and clusters are small numbers, -1 for none."""
    bins = Bins(capacity, int(sources.max(initial=0)) + 1, int(clusters.max(initial=0)) + 1)
    got = [bins.put(*x) for x in zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)]
    return np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64)


def _codes(values: pa.ChunkedArray, repeated_only: bool = False) -> np.ndarray:
    """Small numbers for the values, -1 for null, and for values met once if these need no bit."""
    column = values.combine_chunks().dictionary_encode()
    codes = pc.fill_null(column.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if repeated_only and len(codes):
        often = np.bincount(codes[codes >= 0], minlength=len(column.dictionary)) > 1
        number = np.where(often, np.cumsum(often) - 1, -1)
        codes = np.r_[number, -1][codes]
    return codes


def pack(df: DataFrame, id_col: Column, length: Column, source: Column, cluster: Column, capacity: int = CAPACITY, docs_a_task: int = DOCS_A_TASK) -> DataFrame:
    """doc_id, piece, start and length (in the document), bin and offset (in the bin), and the bin's task.

    A bin's number is unique over all tasks: the task's number in the high bits.
    """
    rows = df.select(id_col.cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("n"), source.cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    tasks = shares(df.count(), docs_a_task)
    # xxhash64 skips nulls, so rows without id are spread by their other columns.
    rows = rows.withColumn("task", F.pmod(F.xxhash64("doc_id", "n", "source", "cluster"), F.lit(tasks)))

    def run(t: pa.Table) -> pa.Table:
        task = t.column("task")[0].as_py()
        n = t.column("n").to_numpy()
        pieces = np.maximum(1, -(-n // capacity))
        at = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[at] - piece * capacity)
        # Ids stay whole numbers; rows without one come last among equal sizes.
        doc_id = t.column("doc_id").combine_chunks()
        without = doc_id.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc_id, 0).to_numpy()
        order = np.lexsort((piece, ids[at], without[at], -size))
        order = order[size[order] > 0]
        number, offset = pack_pieces(size[order], _codes(t.column("source"))[at][order], _codes(t.column("cluster"), True)[at][order], capacity)
        placed = np.zeros((2, len(at)), np.int64)
        placed[:, order] = number + (task << 32), offset
        columns = [doc_id.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(size, pa.int64())]
        return pa.table([*columns, *(pa.array(x, pa.int64(), mask=size == 0) for x in placed)], names=["doc_id", "piece", "start", "n", "bin", "offset"])

    return rows.groupBy("task").applyInArrow(run, "doc_id long, piece int, start long, n long, bin long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, docs_a_task: int = DOCS_A_TASK) -> DataFrame:
    """Documents by words; a bin never holds two pieces of one source or two texts that are equal but for case and blanks."""
    own = words(ascii_lower(F.col("text")))
    length = F.size(own)
    cluster = F.when(length > 0, F.xxhash64(F.array_join(own, " ")))
    return pack(docs, F.col("doc_id"), length, F.col("source"), cluster, capacity, docs_a_task)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2,048 words."""
    return pack_documents(table(spark, sf_dir, "documents"))
