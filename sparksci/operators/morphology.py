"""Morphology of images in long form (img, y, x, v): separable window frames by row, then by column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators import graph


def _swept(df: DataFrame, agg, h: int) -> DataFrame:
    along = df.withColumn("v", agg("v").over(Window.partitionBy("img", "y").orderBy("x").rowsBetween(-h, h)))
    return along.withColumn("v", agg("v").over(Window.partitionBy("img", "x").orderBy("y").rowsBetween(-h, h)))


def grey_erosion(df: DataFrame, size: int = 3) -> DataFrame:
    """Least value of the square around each pixel; ends repeat their last value, which a shrinking window equals."""
    return _swept(df, F.min, size // 2)


def grey_dilation(df: DataFrame, size: int = 3) -> DataFrame:
    return _swept(df, F.max, size // 2)


def grey_opening(df: DataFrame, size: int = 3) -> DataFrame:
    return grey_dilation(grey_erosion(df, size), size)


def grey_closing(df: DataFrame, size: int = 3) -> DataFrame:
    return grey_erosion(grey_dilation(df, size), size)


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "__b"), ["img", "y", "x"]).select("img", "y", "x", (F.col("v") - F.col("__b")).alias("v"))


def morphological_gradient(df: DataFrame, size: int = 3) -> DataFrame:
    return _minus(grey_dilation(df, size), grey_erosion(df, size))


def white_tophat(df: DataFrame, size: int = 3) -> DataFrame:
    return _minus(df, grey_opening(df, size))


def black_tophat(df: DataFrame, size: int = 3) -> DataFrame:
    return _minus(grey_closing(df, size), df)


def binarised(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.when(F.col("v") != 0, 1.0).otherwise(0.0))


def binary_erosion(df: DataFrame, iterations: int = 1) -> DataFrame:
    """1 where the whole 3 x 3 square is nonzero; outside the image is 0."""
    out = binarised(df)
    for _ in range(iterations):
        for line, along in (("y", "x"), ("x", "y")):
            w = Window.partitionBy("img", line).orderBy(along).rowsBetween(-1, 1)
            out = out.withColumn("v", F.when(F.count("*").over(w) == 3, F.min("v").over(w)).otherwise(0.0))
    return out


def binary_dilation(df: DataFrame, iterations: int = 1) -> DataFrame:
    out = binarised(df)
    for _ in range(iterations):
        out = _swept(out, F.max, 1)
    return out


def binary_opening(df: DataFrame, iterations: int = 1) -> DataFrame:
    return binary_dilation(binary_erosion(df, iterations), iterations)


def binary_closing(df: DataFrame, iterations: int = 1) -> DataFrame:
    return binary_erosion(binary_dilation(df, iterations), iterations)


def label(df: DataFrame, full: bool = False) -> DataFrame:
    """(img, y, x, v, label): connected nonzero pixels, numbered from 1 within each image in reading order; 0 elsewhere."""
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if full else [])]
    own = df.where("v <> 0").select("img", "y", "x")
    # One number for a pixel: image, row and column in mixed radix of 2**21.
    code = lambda img, y, x: (img.cast("long") * (1 << 42)) + y.cast("long") * (1 << 21) + x.cast("long")
    fits = F.col("y").between(0, (1 << 21) - 2) & F.col("x").between(0, (1 << 21) - 2)
    own = own.where(F.when(fits & F.col("img").between(0, (1 << 21) - 1), True).otherwise(F.raise_error(F.lit("images, rows and columns to be labelled are numbered from 0 and below 2**21 - 1")).cast("boolean")))
    here = own.withColumn("id", code(F.col("img"), F.col("y"), F.col("x")))
    near = here.select(F.col("id").alias("src"), F.explode(F.array(*(code(F.col("img"), F.col("y") + a, F.col("x") + b) for a, b in steps))).alias("dst"))
    links = near.join(here.select(F.col("id").alias("dst")), "dst").select("src", "dst", F.lit(1.0).alias("w"))
    found = graph.connected_components(links, here.select("id"))
    names = found.select("component", F.floor(F.col("component") / (1 << 42)).alias("img")).distinct()
    numbered = names.withColumn("label", F.row_number().over(Window.partitionBy("img").orderBy("component")).cast("long")).drop("img")
    marked = here.join(found, "id").join(numbered, "component").select("img", "y", "x", "label")
    return df.join(marked, ["img", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))


def find_objects(labelled: DataFrame) -> DataFrame:
    """Bounding box (ends exclusive) and area of each label."""
    return labelled.where("label > 0").groupBy("img", "label").agg(
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.count("*").alias("area")
    )


def label_statistics(labelled: DataFrame) -> DataFrame:
    """Sum, mean and centre of mass of each label."""
    s = F.sum("v")
    c = lambda k: F.when(s != 0, F.sum(F.col("v") * F.col(k)) / s).otherwise(0.0)
    return labelled.where("label > 0").groupBy("img", "label").agg(s.alias("sum"), F.avg("v").alias("mean"), c("y").alias("cy"), c("x").alias("cx"))
