"""Readers for Spark's file formats and adapters to the shapes that operators take."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "avro", "text")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    if kind not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"one of {', '.join(FORMATS)}")
    df.write.format(kind).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(df: DataFrame, by: list[str], order: Column, value: Column) -> DataFrame:
    """(by, t, x): one row a sample."""
    return df.select(*by, order.alias("t"), value.cast("double").alias("x"))


def points(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v as array<double>."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda c: c.cast("double")).alias("v"))


def edges(df: DataFrame, src: Column, dst: Column, weight: Column | None = None, directed: bool = True) -> DataFrame:
    """(src, dst, w), parallel edges added up; both directions if undirected."""
    one = df.select(src.cast("long").alias("src"), dst.cast("long").alias("dst"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("w"))
    both = one if directed else one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def image(df: DataFrame, y: Column, x: Column, value: Column, height: int, width: int, img: Column | None = None) -> DataFrame:
    """(img, y, x, v): a complete grid, 0 where the table has nothing; values of a pixel add up."""
    held = df.select((img if img is not None else F.lit(0)).alias("img"), y.cast("int").alias("y"), x.cast("int").alias("x"), value.cast("double").alias("v")).groupBy("img", "y", "x").agg(F.sum("v").alias("v"))
    frame = held.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("img", "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return frame.join(held, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where none is named (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if named is None and not _own:
        _own.append(tempfile.mkdtemp(prefix="sparksci-"))
    return (named or _own[0]).rstrip("/")


#: Spark's own setting: the shuffle files of a query are removed when it ends.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """For writes of tables: no later plan reads their shuffles, so a chain of steps holds those of one step only."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP)
        else:
            spark.conf.set(SWEEP, before)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; ``forget`` removes it when no later plan reads it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sparksci-tables/{uuid.uuid4().hex}"
    with swept(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored = path
    return back


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``stored`` in buckets of ``key``: joins and groups by it leave these rows where they lie. The catalog forgets the name at once."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sparksci_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/sparksci-tables/{name}"
    with swept(spark):
        df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    back._stored = path
    return back


def settled(df: DataFrame) -> DataFrame:
    """df, computed and cut from its lineage: iterations stay short and survive lost executors.

    It is a stored table, not a checkpoint: a checkpoint keeps the size that was estimated for its plan, and joins
    multiply estimates, so the number doubles its digits with every round until it fills the driver. Files have their own size.
    """
    return stored(df)


def forget(*frames: DataFrame | None) -> None:
    """Remove tables that ``stored`` wrote."""
    for df in frames:
        path = getattr(df, "_stored", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
