"""The corpus pipeline: language identification, line and near deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept.  All stages but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.llm import language_id, line_dedup, near_dedup, packing
from sparksci.llm.common import discard, table, written

#: Documents under this score resemble no language that the corpus has: their n-grams are in no profile.
LEAST_SCORE = 0.02


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letters, or n-grams of no known language, go."""
    return language_id.identified(docs, language_id.profiles_of(docs), "text", LEAST_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in the last of them only; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one row stays: that with the least id, or any if none has one.

    Repeated rows of an id are rows of the group; rows without words are in no group and all stay.
    """
    doc_id = F.col("doc_id").cast("long")
    often = written(docs.select(doc_id.alias("__often")).groupBy("__often").count().where("__often IS NOT NULL AND count > 1").select("__often"), "pipeline-often")
    # Rows that their id does not tell apart are numbered; there are few of them, and the others are not written again.
    apart = docs.where(doc_id.isNull()).unionByName(docs.join(often, doc_id == F.col("__often"), "left_semi"))
    loose = written(apart.withColumn("__row", F.monotonically_increasing_id()), "pipeline-loose")
    named = docs.where(doc_id.isNotNull()).join(often, doc_id == F.col("__often"), "left_anti")
    rows = named.withColumn("__row", F.lit(None).cast("long")).unionByName(loose)
    kept = near_dedup.near_duplicates(rows, width=5, similarity=0.8, row_col="__row").where("kept").select(F.col("doc_id").alias("__kept"), F.col("__row").alias("__kept_row"))
    return rows.join(kept, doc_id.eqNullSafe(F.col("__kept")) & F.col("__row").eqNullSafe(F.col("__kept_row")), "left_semi").drop("__row")


def pack_into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 words, no two of one source or of equal texts."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("packing", pack_into_sequences),
]

#: MinHash links and best-fit packing have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the stage before; the documents themselves are no scratch table
    return docs
