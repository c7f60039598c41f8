"""Shared helpers of the training-data operators: text keys, scratch tables, sizes."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparksci.sources.tables import swept

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Space and the control characters 9 to 13, the white space of every key here.
BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"

_fallback: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Maximal runs of characters other than blanks; null text has none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_BREAK), lambda w: w != "")


def word_hashes(c: Column) -> Column:
    """64-bit hashes of the lower-cased words, in order: compact input for numpy."""
    return F.transform(words(ascii_lower(c)), lambda w: F.xxhash64(w))


def byte_length(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


#: Buckets of a table at most: the catalog's own bound is 100,000. Beyond it a bucket holds several keys.
MOST_BUCKETS = 1 << 16


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _fallback:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _fallback.append(tempfile.mkdtemp(prefix="sparksci-"))
    return _fallback[0]


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sparksci/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with swept(spark):
        writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def bucketed(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """df written to the shared folder in buckets of a key without nulls: later groupings by the key need no shuffle of it."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path, n = f"{scratch_dir(spark)}/sparksci/{unique}", min(parts, MOST_BUCKETS)
    entry = f"sparksci_{unique}".replace("-", "_")
    with swept(spark):
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(entry, format="parquet")
    back = spark.table(entry)
    back._scratch = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of these operators: call it once their results are written elsewhere."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sparksci")
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def shares(total: float, each: float, least: int = 1) -> int:
    """How many parts of about ``each`` hold ``total``; grows in proportion to the data."""
    return max(least, math.ceil((total or 0) / each))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the splitmix64 finaliser); fixed values are its constants."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sequence_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-token windows of a token-hash sequence (empty if it is shorter)."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.full(m, np.uint64(n), np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + m])
    return h
