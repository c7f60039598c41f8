"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

``LineIndex`` keeps two tables: exact reference counts, a row for each line key and
document, and one cuckoo filter for each shard of keys that holds the fingerprints
of the keys found in enough documents.  Documents can be inserted and deleted; the
filters follow through insertions and deletions of fingerprints.  A batch's distinct
keys are probed against the filters shard by shard and only what passes is checked
against the exact counts, so a filter's false positives never cost a line.

Defined cases: null text is one empty line; lines of rows without id are never
counted and stay; repeated rows of a document count as one document, whose lines are
those of all its rows, and each row loses the lines that the document loses; ties do
not arise, as the largest id keeps its lines. A filter that a batch fills up is rebuilt
from the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm.common import BLANKS, ascii_lower, mix64, shares, table, written

MIN_LENGTH = 20
MIN_DOCS = 3
SLOTS = 4
KICKS = 500
KEYS_A_SHARD = 100_000


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints in buckets of four; both buckets follow from either and the fingerprint."""

    def __init__(self, table: np.ndarray):
        self.t = table

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        return cls(np.zeros((1 << max(1, int(keys / SLOTS / 0.85)).bit_length(), SLOTS), np.uint16))

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(keys.view(np.uint64))
        prints = (h >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (h & np.uint64(len(self.t) - 1)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, prints):
        return bucket ^ (mix64(np.atleast_1d(np.asarray(prints))) & np.uint64(len(self.t) - 1)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        p, a, b = self.places(keys)
        return ((self.t[a] == p[:, None]) | (self.t[b] == p[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a fingerprint finds no place: the filter must be rebuilt larger."""
        prints, first, second = self.places(keys)
        t, n = self.t, 0
        for p, a, b in zip(prints.tolist(), first.tolist(), second.tolist(), strict=True):
            for bucket in (a, b):
                free = np.flatnonzero(t[bucket] == 0)
                if len(free):
                    t[bucket, free[0]] = p
                    break
            else:
                bucket = a
                for kick in range(KICKS):
                    n += 1
                    slot = (n + kick) % SLOTS
                    p, t[bucket, slot] = int(t[bucket, slot]), p
                    bucket = int(self.other(np.int64(bucket), p)[0])
                    free = np.flatnonzero(t[bucket] == 0)
                    if len(free):
                        t[bucket, free[0]] = p
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            for bucket in (a, b):
                own = np.flatnonzero(self.t[bucket] == p)
                if len(own):
                    self.t[bucket, own[0]] = 0
                    break


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    """128 bits of MD5: equal keys and no others, for any corpus; short enough to shuffle."""
    return F.unhex(F.md5(key))


def key_hashes(text: Column) -> Column:
    """Hashes of the keys of the lines that are long enough."""
    return F.transform(F.filter(F.transform(lines_of(text), line_key), lambda k: F.length(k) >= MIN_LENGTH), key_hash)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def _short(keys: pa.Array) -> np.ndarray:
    """The first 64 bits of each 128-bit key, as the filters take them."""
    return np.frombuffer(b"".join(k[:8] for k in keys.to_pylist()), np.int64)


class LineIndex:
    """refs: (key, doc_id), distinct. filters: (shard, keys, filter), one row a shard."""

    def __init__(self, refs: DataFrame, filters: DataFrame, shards: int, min_docs: int = MIN_DOCS):
        self.refs, self.filters, self.shards, self.min_docs = refs, filters, shards, min_docs

    @staticmethod
    def references(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The distinct (key, doc_id) of the lines that count."""
        keys = F.explode(F.array_distinct(key_hashes(F.col(text_col)))).alias("key")
        return df.where(F.col(id_col).isNotNull()).select(keys, F.col(id_col).cast("long").alias("doc_id")).distinct()

    @staticmethod
    def counts(refs: DataFrame) -> DataFrame:
        return refs.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    @classmethod
    def build(cls, df: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        refs = written(cls.references(df, id_col, text_col), "line-refs")
        held = cls.counts(refs).where(F.col("n_docs") >= min_docs)
        shards = shares(refs.count(), KEYS_A_SHARD, df.sparkSession.sparkContext.defaultParallelism)
        return cls(refs, cls._filters(held, shards), shards, min_docs)

    @staticmethod
    def _filters(held: DataFrame, shards: int) -> DataFrame:
        def fill(key, batch: pa.Table) -> pa.Table:
            keys = _short(batch.column(0))
            room = len(keys)
            while not (f := Cuckoo.sized(room)).insert(keys):
                room = 2 * room + 1
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([f.t.tobytes()], pa.binary())], names=["shard", "keys", "filter"])

        made = held.select("key", _shard(F.col("key"), shards).alias("shard")).groupBy("shard").applyInArrow(lambda k, t: fill(k, t), "shard int, keys long, filter binary")
        return written(made, "line-filters")

    def _follow(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index over other references; only the filters' keys that crossed the threshold change."""
        was = self.counts(self.refs.join(touched, "key", "left_semi")).select("key", (F.col("n_docs") >= self.min_docs).alias("was"))
        now = self.counts(refs.join(touched, "key", "left_semi")).select("key", (F.col("n_docs") >= self.min_docs).alias("now"))
        moved = (
            was.join(now, "key", "full")
            .select("key", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("now", F.lit(False)).alias("now"))
            .where("was != now")
            .select("key", "now", _shard(F.col("key"), self.shards).alias("shard"))
        )

        def change(key, filters: pa.Table, moves: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            n = filters.column(1)[0].as_py() if filters.num_rows else 0
            f = Cuckoo(np.frombuffer(filters.column(2)[0].as_py(), np.uint16).reshape(-1, SLOTS).copy()) if filters.num_rows else Cuckoo.sized(moves.num_rows)
            keys, now = _short(moves.column(0)), moves.column(1).to_numpy().astype(bool)
            f.delete(keys[~now])
            n += int(now.sum()) - int((~now).sum())
            full = not f.insert(keys[now])
            return pa.table([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([None if full else f.t.tobytes()], pa.binary())], names=["shard", "keys", "filter"])

        filters = written(self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(lambda k, a, b: change(k, a, b), "shard int, keys long, filter binary"), "line-filters")
        full = filters.where("filter IS NULL").select("shard")
        if not full.isEmpty():  # these shards outgrew their filters: they are rebuilt from the exact counts, as large as they need
            held = self.counts(refs).where(F.col("n_docs") >= self.min_docs).withColumn("shard", _shard(F.col("key"), self.shards)).join(full, "shard", "left_semi")
            filters = written(filters.where("filter IS NOT NULL").unionByName(self._filters(held, self.shards)), "line-filters")
        return LineIndex(refs, filters, self.shards, self.min_docs)

    def insert(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = written(self.references(df, id_col, text_col), "line-new")
        return self._follow(written(self.refs.union(new).distinct(), "line-refs"), new.select("key").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take whole documents out again; ids: a table with their doc_id."""
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        touched = self.refs.join(gone, "doc_id", "left_semi").select("key").distinct()
        return self._follow(written(self.refs.join(gone, "doc_id", "left_anti").select("key", "doc_id"), "line-refs"), touched)

    def repeated(self, keys: DataFrame) -> DataFrame:
        """Of distinct keys, those in enough documents: filters first, exact counts after; with the document that keeps them."""

        def probe(key, asked: pa.Table, filters: pa.Table) -> pa.Table:
            names = asked.column(0).combine_chunks()
            if not filters.num_rows:
                return pa.table([names.slice(0, 0)], names=["key"])
            f = Cuckoo(np.frombuffer(filters.column(2)[0].as_py(), np.uint16).reshape(-1, SLOTS))
            return pa.table([names.filter(pa.array(f.holds(_short(names))))], names=["key"])

        asked = keys.select("key", _shard(F.col("key"), self.shards).alias("shard"))
        maybe = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(lambda k, a, b: probe(k, a, b), "key binary")
        exact = self.counts(self.refs).where(F.col("n_docs") >= self.min_docs)
        return maybe.join(exact, "key")


def dropped_keys(refs: DataFrame, index: LineIndex) -> DataFrame:
    """doc_id and the keys that lose their lines there, in about as many cells by hash as a cell has keys."""
    # Written, so that the join below is between two plain exchanges and a hot key's rows can be split.
    found = written(index.repeated(refs.select("key").distinct()).select("key", "last_doc"), "line-found")
    gone = refs.join(found, "key").where(F.col("doc_id") < F.col("last_doc")).groupBy("doc_id").agg(F.collect_list("key").alias("gone"))
    cells = F.ceil(F.sqrt(F.size("gone"))).cast("int")
    return gone.select("doc_id", F.transform(F.sequence(F.lit(0), cells - 1), lambda c: F.filter("gone", lambda g: _cell(g, cells) == c)).alias("gone"))


def _cell(key: Column, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key), cells).cast("int")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, index: LineIndex | None = None) -> DataFrame:
    """All columns of df, its text without repeated lines, and n_lines and n_dropped."""
    index = index or LineIndex.build(df, min_docs, id_col, text_col)
    gone = dropped_keys(index.refs, index).select(F.col("doc_id").alias("__id"), F.col("gone").alias("__gone"))
    joined = df.join(gone, F.col(id_col).cast("long") == F.col("__id"), "left")
    lines, gone = lines_of(F.col(text_col)), F.col("__gone")
    # A line is sought in its hash's cell only, so a long document costs far less than lines times gone keys.
    is_gone = lambda h: F.array_contains(F.get(gone, _cell(h, F.size(gone))), h)
    stay = F.when(gone.isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(line_key(x)) < MIN_LENGTH) | ~is_gone(key_hash(line_key(x)))))
    kept = joined.withColumn("__stay", stay)
    n, left = F.size(lines).cast("long"), F.size("__stay").cast("long")
    own = [F.col(c) for c in df.columns if c not in (text_col, "n_lines", "n_dropped")]
    return kept.select(*own, F.array_join("__stay", "\n").alias(text_col), n.alias("n_lines"), (n - left).alias("n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those dropped, and the digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed
  WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
