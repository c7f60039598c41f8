"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

Documents are dealt to blocks by a hash, and a block asks for its distinct n-grams, with
how often it has each.  The questions are exploded to rows (block, gram, own) that are
partitioned by the grams' hash; summed by gram they give the count tables, each row meets
its gram's sum there, and what each block asked for goes home to it, where the words'
scores are summed by document.  A document is scored by what the rest of the corpus says: its own
occurrences are taken off every count.

Orders follow each other: an n-gram of three words or more is asked for only if both
(n-1)-grams in it are found elsewhere, as otherwise it cannot be.  Between the exchange
and the explosion the n-grams of a block and partition are one row with arrays, so rows
shuffled are few and n-grams cost their hash.

For a word after its context: count(context, word) / count(context) if the n-gram is
found elsewhere, else 0.4 times the score after the context without its first word;
a word found nowhere else scores 0.4 / (words of the rest of the corpus).

Defined cases: null and empty texts have no words, a score of 0 and a null mean; rows
without id are scored too; repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.llm.common import BLANKS, ascii_lower, bucketed, byte_length, sequence_hashes, shares, table, words, written

ORDER = 3
BACKOFF = 0.4
#: Bytes of text in a block: what a Python worker holds, and within which n-grams are counted before they are shuffled.
BLOCK_BYTES = 12 << 20
#: Rows (block, gram), about, in one hash partition.
PART_ROWS = 1_500_000
BYTES_A_WORD = 6
PACKED_ROWS = 500_000
TOLD = "block long, n int, at array<int>, total array<long>"
ASKED = "part int, block long, n int, first int, grams array<long>, own array<int>"


def _stable_order(hashes: np.ndarray) -> np.ndarray:
    """np.argsort(hashes, kind="stable"), several times as fast on hashes: their leading bits and places are sorted as one number."""
    low = np.uint64((1 << len(hashes).bit_length()) - 1)
    both = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    ranked = hashes[order]
    if (ranked[1:] < ranked[:-1]).any():  # hashes that differ in their last bits only
        return np.argsort(hashes, kind="stable")
    return order


class Block:
    """The words of some documents and their n-grams."""

    def __init__(self, texts: pa.ChunkedArray):
        trimmed = pc.ascii_trim(pc.ascii_lower(pc.fill_null(texts, "")), BLANKS)
        split = pc.ascii_split_whitespace(trimmed).combine_chunks()
        self.length = np.where(pc.binary_length(trimmed).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0)
        flat = split.flatten()
        if not self.length.all():  # an empty text splits into one empty word; no other word is empty
            flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
        met = flat.dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in met.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        self.words = hashes[met.indices.to_numpy()]
        self.doc = np.repeat(np.arange(len(self.length)), self.length)
        self.elsewhere: dict[int, np.ndarray] = {}

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams to ask for and the positions where they end (order 0: the words in all)."""
        if n == 0:
            return np.zeros(len(self.words), np.uint64), np.arange(len(self.words))
        end = np.arange(n - 1, len(self.words))
        likely = self.doc[end] == self.doc[end - n + 1]
        if n > 2:  # both shorter n-grams are found elsewhere
            likely &= (self.elsewhere[n - 1][end] > 0) & (self.elsewhere[n - 1][end - 1] > 0)
        return sequence_hashes(self.words, n)[likely], end[likely]

    def distinct(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams to ask for in order, their counts, and of the sorted windows where each n-gram begins and where each window ends.

        The sort is stable, so the windows of an n-gram are in order of their documents.
        """
        hashes, end = self.windows(n)
        order = _stable_order(hashes)
        ranked = hashes[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)]
        starts = np.flatnonzero(new)
        return ranked[starts], np.diff(np.r_[starts, len(ranked)]), new, end[order]

    def learn(self, n: int, told: pa.Table) -> None:
        """Counts without the document's own, at the position of the n-gram's last word; 0 where it is found nowhere else."""
        _, totals, new, end = self.distinct(n)
        own = told.filter(pc.equal(told.column("n"), n))  # other n-grams are found in this block only
        totals[pc.list_flatten(own.column("at")).to_numpy()] = pc.list_flatten(own.column("total")).to_numpy()
        doc = self.doc[end]
        pairs = np.flatnonzero(new | np.r_[True, doc[1:] != doc[:-1]][: len(doc)])  # where an n-gram's windows in one document begin
        times = np.diff(np.r_[pairs, len(doc)])
        out = np.zeros(len(self.words), np.int64)
        out[end] = np.repeat(totals[np.cumsum(new)[pairs] - 1] - times, times)
        self.elsewhere[n] = out


def _asked(block: Block, number: int, orders: range, bits: int) -> pa.Table:
    """The distinct n-grams of a block and its counts, a row for each order and hash partition (the leading bits)."""
    rows = []
    for n in orders:
        grams, counts, _, _ = block.distinct(n)
        bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
        cut = np.r_[np.searchsorted(grams, bounds), len(grams)]
        for part in np.flatnonzero(np.diff(cut)).tolist():
            a, b = int(cut[part]), int(cut[part + 1])
            rows.append((part, number, n, a, grams[a:b].view(np.int64), counts[a:b].astype(np.int32)))
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "block", "n", "first", "grams", "own"])


def _counted(asked: DataFrame, parts: int) -> DataFrame:
    """(block, n, at, total) of every n-gram asked for that is found in other blocks too: exploded n-grams and, beside each, its row of the count table.

    Rows are partitioned by the grams' hash once; a window over each gram sums it and joins the sum back without another shuffle.
    """
    each = F.posexplode(F.arrays_zip("grams", "own"))
    dealt = asked.repartition(parts, "part").select("part", "block", "n", "first", each.alias("pos", "gram"))
    rows = dealt.select("part", "n", F.col("gram.grams").alias("gram"), "block", (F.col("first") + F.col("pos")).alias("at"), F.col("gram.own").alias("own"))
    total = F.sum("own").over(Window.partitionBy("gram", "n", "part"))
    return rows.select("block", "n", "at", "own", total.alias("total")).where("total > own").drop("own").mapInArrow(_packed, TOLD)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, n, at, total) as one row with arrays for each block and order of many rows."""
    held: list[pa.RecordBatch] = []

    def rows() -> pa.RecordBatch:
        block, n, at, total = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(4))
        key = block * (int(n.max()) + 1) + n
        order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")  # 16 bits are sorted digit by digit
        block, n = block[order], n[order]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (n[1:] != n[:-1])])
        ends = pa.array(np.r_[starts, len(block)], pa.int32())
        lists = (pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (at, total))
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array(n[starts]), *lists], names=["block", "n", "at", "total"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED_ROWS:
            yield rows()
            held = []
    if any(b.num_rows for b in held):
        yield rows()


def score(df: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score (the sum of log10 of the words' scores) and mean_score for every row."""
    text = F.col(text_col)
    size = df.agg(F.sum(byte_length(text))).first()[0] or 0
    blocks = shares(size, BLOCK_BYTES)
    bits = (shares(2 * size / BYTES_A_WORD, PART_ROWS) - 1).bit_length()
    spread = F.pmod(F.xxhash64(F.col(id_col), F.crc32(F.coalesce(text, F.lit("")))), F.lit(blocks))

    def first(key, t):
        return _asked(Block(t.column("text")), key[0].as_py(), range(min(order, 2) + 1), bits)

    def further(n: int):
        def run(key, t, told):
            block = Block(t.column("text"))
            for k in range(2, n):
                block.learn(k, told)
            return _asked(block, key[0].as_py(), range(n, n + 1), bits)

        return run

    def scored(key, t, told):
        block = Block(t.column("text"))
        for k in range(order + 1):
            block.learn(k, told)
        return _scores(block, order, t.column("doc_id"))

    # The texts are exchanged once: every step reads its blocks from buckets.
    docs = bucketed(df.select(spread.alias("block"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text")), "lm-docs", "block", blocks)
    told = written(_counted(docs.groupBy("block").applyInArrow(first, ASKED), 1 << bits), "lm-told")
    for n in range(3, order + 1):
        more = docs.groupBy("block").cogroup(told.where("n > 1").groupBy("block")).applyInArrow(further(n), ASKED)
        told = told.union(written(_counted(more, 1 << bits), "lm-told"))
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, score double, mean_score double")


def _scores(block: Block, order: int, doc_id: pa.ChunkedArray) -> pa.Table:
    n_docs, n_words, elsewhere = len(block.length), len(block.words), block.elsewhere
    place = np.arange(n_words) - np.repeat(np.cumsum(block.length) - block.length, block.length)
    value = np.where(elsewhere[1] > 0, elsewhere[1], BACKOFF) / np.maximum(1, elsewhere[0])
    for n in range(2, order + 1):
        context = np.r_[np.int64(1), elsewhere[n - 1][:-1]][:n_words]
        found = elsewhere[n] > 0
        # Where the document is too short for this order there is no longer context to back off from.
        value = np.where(found, elsewhere[n] / np.maximum(1, context), np.where(place < n - 1, value, BACKOFF * value))
    total = np.bincount(block.doc, np.log10(value), n_docs)
    mean = [s / k if k else None for s, k in zip(total.tolist(), block.length.tolist(), strict=True)]
    return pa.table([doc_id, pa.array(block.length, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "score", "mean_score"])


def ngram_counts(df: DataFrame, order: int = ORDER, text_col: str = "text") -> DataFrame:
    """The count tables themselves: (n, gram, count) for users, by DataFrame operations alone."""
    none = F.array().cast("array<struct<n:int,gram:string>>")

    def grams(n: int):
        every = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("w", i, F.lit(n)), " ").alias("gram")))
        return F.when(F.size("w") >= n, every).otherwise(none)

    held = df.select(words(ascii_lower(F.col(text_col))).alias("w"))
    return held.select(F.explode(F.concat(*(grams(n) for n in range(1, order + 1)))).alias("g")).groupBy("g.n", "g.gram").agg(F.count("*").alias("count"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the trigram counts of all others."""
    out = score(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_score", 4).alias("mean_score"))


ORACLE = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), tokens AS (
  SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS pos FROM words
), grams AS (
  SELECT doc_id, pos, c, lag(c) OVER d AS b, lag(c, 2) OVER d AS a FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), keyed AS (
  SELECT doc_id, pos, c AS k1, b || ' ' || c AS k2, a || ' ' || b || ' ' || c AS k3, b AS p1, a || ' ' || b AS p2 FROM grams
), own AS (
  SELECT 1 AS n, doc_id, k1 AS k, count(*) AS own FROM keyed GROUP BY doc_id, k1
  UNION ALL SELECT 2, doc_id, k2, count(*) FROM keyed WHERE k2 IS NOT NULL GROUP BY doc_id, k2
  UNION ALL SELECT 3, doc_id, k3, count(*) FROM keyed WHERE k3 IS NOT NULL GROUP BY doc_id, k3
), found AS (
  SELECT doc_id, n, k, elsewhere FROM (SELECT doc_id, n, k, sum(own) OVER (PARTITION BY n, k) - own AS elsewhere FROM own) WHERE elsewhere > 0
), rests AS (
  SELECT doc_id, greatest(1, (SELECT count(*) FROM tokens) - count(*)) AS rest FROM tokens GROUP BY doc_id
), scored AS (
  SELECT t.doc_id, log10(CASE WHEN f3.elsewhere > 0 THEN f3.elsewhere::DOUBLE / c2.elsewhere
                              WHEN f2.elsewhere > 0 THEN CASE WHEN t.pos > 2 THEN 0.4 ELSE 1.0 END * (f2.elsewhere::DOUBLE / c1.elsewhere)
                              ELSE CASE WHEN t.pos > 2 THEN 0.4 * 0.4 WHEN t.pos > 1 THEN 0.4 ELSE 1.0 END * (coalesce(f1.elsewhere, 0.4)::DOUBLE / r.rest) END) AS s
  FROM keyed t JOIN rests r ON r.doc_id = t.doc_id
  LEFT JOIN found f1 ON f1.doc_id = t.doc_id AND f1.n = 1 AND f1.k = t.k1
  LEFT JOIN found f2 ON f2.doc_id = t.doc_id AND f2.n = 2 AND f2.k = t.k2
  LEFT JOIN found f3 ON f3.doc_id = t.doc_id AND f3.n = 3 AND f3.k = t.k3
  LEFT JOIN found c1 ON c1.doc_id = t.doc_id AND c1.n = 1 AND c1.k = t.p1
  LEFT JOIN found c2 ON c2.doc_id = t.doc_id AND c2.n = 2 AND c2.k = t.p2
), sums AS (SELECT doc_id, sum(s) AS score FROM scored GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(coalesce(s.score, 0), 4) AS score, round(s.score / len(d.w), 4) AS mean_score
FROM words d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""
