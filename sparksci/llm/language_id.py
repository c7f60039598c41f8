"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams (one to three characters within
words, word ends marked), in order.  A document takes the language whose profile is
at the least out-of-place distance from the document's own ranking.

Defined cases: null text and text without letters give ``und`` with score 0; equal
counts rank by n-gram, equal distances go to the language that sorts first; rows
without a language teach nothing; with nothing to learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.llm.common import table

#: N-grams in a profile and of a document's own ranking; also the distance of one that is not in place at all.
PROFILE = 400
#: Characters counted at a time while learning.
CHUNK = 1 << 20
UNKNOWN = "und"
PAIR = np.uint64(1) << np.uint64(63)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, as numbers, and how often each occurs."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_letters()[code], code, 0)
    code = code[np.r_[True, (code[1:] | code[:-1]) != 0]]  # one mark between words
    symbols, dense = np.unique(code, return_inverse=True)
    n = len(symbols)
    if n < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    wide = symbols.astype(np.uint64)
    three = (dense[:-2] * n + dense[1:-1]) * n + dense[2:]
    if n**3 <= 4 * len(code) + 65536:
        counted = np.bincount(three, minlength=n**3)
        key = np.flatnonzero(counted)
        times = counted[key]
    else:
        key, times = np.unique(three, return_counts=True)
    inner = key // n % n > 0
    key, times = key[inner], times[inner]
    grams3 = wide[key // (n * n)] << np.uint64(42) | wide[key // n % n] << np.uint64(21) | wide[key % n]
    counted = np.bincount(dense[:-1] * n + dense[1:], minlength=n * n)
    key = np.flatnonzero(counted)
    grams2 = PAIR | wide[key // n] << np.uint64(21) | wide[key % n]
    counts1 = np.bincount(dense, minlength=n)[1:]
    return np.concatenate([wide[1:], grams2, grams3]), np.concatenate([counts1, counted[key], times])


def ranking(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.lexsort((grams, -counts))[:size]]


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, rank) from all rows that have a language; counts are summed before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[str]] = {}
        held: dict[str, int] = {}

        def take(lang: str) -> None:
            grams, counts = gram_counts("\n".join(waiting.pop(lang)))
            held.pop(lang)
            if lang in known:
                g, at = np.unique(np.concatenate([known[lang][0], grams]), return_inverse=True)
                grams, counts = g, np.bincount(at, np.concatenate([known[lang][1], counts]), len(g)).astype(np.int64)
            known[lang] = grams, counts

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    waiting.setdefault(lang, []).append(text)
                    held[lang] = held.get(lang, 0) + len(text)
                    if held[lang] > CHUNK:
                        take(lang)
        for lang in list(waiting):
            take(lang)
        for lang, (grams, counts) in known.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])

    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Unsigned order of the n-grams, as in ranking().
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


class Profiles:
    """All profiles as one matrix of ranks: a language's size is bounded, so this is languages x PROFILE numbers."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        grams = np.array([r[1] for r in rows], np.int64).view(np.uint64)
        self.grams = np.unique(grams)
        self.rank = np.full((len(self.langs), len(self.grams)), -1, np.int32)
        lang = np.searchsorted(self.langs, [r[0] for r in rows]) if rows else np.empty(0, np.int64)
        self.rank[lang, np.searchsorted(self.grams, grams)] = [r[2] for r in rows]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        own = ranking(*gram_counts(text), self.size)
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        found = self.rank[:, at]
        away = np.where((found >= 0) & (self.grams[at] == own), np.abs(found - np.arange(len(own))), self.size)
        total = away.sum(axis=1)
        best = int(np.argmin(total))
        return self.langs[best], 1.0 - float(total[best]) / (self.size * len(own))


def profiles_of(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    rows = [(r["lang"], r["gram"], r["rank"]) for r in learn(df, text_col, lang_col, size).collect()]
    return Profiles(rows, size)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predict(df: DataFrame, profiles: Profiles, text_col: str = "text", *keep: Column) -> DataFrame:
    """The columns ``keep`` of df, lang_pred and score. Map-only."""
    kept = df.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", lang_pred string, score double"
    own = df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [own.value.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            langs, scores = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"]
            )

    return df.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def identified(df: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """df without the rows whose text has no language, or a score under ``least``; columns as they were."""
    at, own = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [own.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in got], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = profiles_of(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, profiles, "text", F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"))


ORACLE = """
WITH crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * len(doc_id::VARCHAR))), lambda c, i:
    xor((CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE c END) >> 1,
        CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE c END) % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)),
    4294967295::BIGINT) % 4 = 2 AS held_out
  FROM documents
), marked AS (
  SELECT d.doc_id, d.lang, c.held_out, ' ' || trim(regexp_replace(lower(coalesce(d.text, '')), '[^\\p{L}]+', ' ', 'g')) || ' ' AS s
  FROM documents d JOIN crc c ON c.doc_id = d.doc_id
), letters AS (
  SELECT doc_id, lang, held_out, string_split(s, '') AS c FROM marked WHERE len(s) > 2
), grams AS (
  SELECT doc_id, lang, held_out, g, count(*) AS n FROM (
    SELECT doc_id, lang, held_out, unnest(list_concat(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])),
                                                      list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS g FROM letters)
  WHERE g <> ' ' AND (len(g) < 3 OR substr(g, 2, 1) <> ' ')
  GROUP BY doc_id, lang, held_out, g
), totals AS (
  SELECT lang, g, sum(n) AS n FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g
), profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, CASE len(g) WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END, g) - 1 AS p FROM totals
  QUALIFY p < 400
), own AS (
  SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, CASE len(g) WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE 2 END, g) - 1 AS k FROM grams
  QUALIFY k < 400
), met AS (
  SELECT o.doc_id, p.lang, sum(400 - abs(o.k - p.p)) AS gained FROM own o JOIN profile p ON p.g = o.g GROUP BY o.doc_id, p.lang
), sizes AS (
  SELECT doc_id, count(*) AS m FROM own GROUP BY doc_id
), every AS (
  SELECT s.doc_id, l.lang, s.m, 400 * s.m - coalesce(x.gained, 0) AS away
  FROM sizes s CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN met x ON x.doc_id = s.doc_id AND x.lang = l.lang
), best AS (
  SELECT doc_id, lang, 1.0::DOUBLE - away::DOUBLE / (400 * m)::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY away, lang) AS r FROM every
)
SELECT m.doc_id, m.held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(b.score, 0.0::DOUBLE) AS score
FROM marked m LEFT JOIN best b ON b.doc_id = m.doc_id AND b.r = 1
"""
