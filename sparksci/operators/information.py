"""Information theory over discrete distributions, samples and predictions.

Probabilities are taken as given (not normalised) and floored at 1e-300 in logarithms.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.functions.special import digamma, elementwise
from sparksci.operators.statistics import _by

FLOOR = 1e-300


def _ln(c: Column) -> Column:
    return F.log(F.greatest(c, F.lit(FLOOR)))


def _scale(base: float | None) -> float:
    return 1.0 if base is None else math.log(base)


def entropy(df: DataFrame, p: str, by=(), base: float | None = None) -> DataFrame:
    return df.groupBy(*_by(by)).agg((F.sum(-F.col(p) * _ln(F.col(p))) / _scale(base)).alias("entropy"))


def kl_divergence(df: DataFrame, p: str, q: str, by=(), base: float | None = None) -> DataFrame:
    return df.groupBy(*_by(by)).agg((F.sum(F.col(p) * (_ln(F.col(p)) - _ln(F.col(q)))) / _scale(base)).alias("kl_divergence"))


def cross_entropy(df: DataFrame, p: str, q: str, by=()) -> DataFrame:
    return df.groupBy(*_by(by)).agg(F.sum(-F.col(p) * _ln(F.col(q))).alias("cross_entropy"))


def nll_loss(df: DataFrame, log_probs: str, target: str, by=()) -> DataFrame:
    """Mean negative log-probability of the target class (from 0)."""
    return df.groupBy(*_by(by)).agg((-F.avg(F.get(F.col(log_probs), F.col(target).cast("int")))).alias("nll_loss"))


def differential_entropy(df: DataFrame, x: str, by=(), k: int = 1) -> DataFrame:
    """k-spacing estimate from the n - k spacings of the ordered values; null below k + 1 values.

    The digamma of each group's size is a helper on the aggregated rows.
    """
    keys = _by(by)
    gap = F.lead(x, k).over(Window.partitionBy(*keys).orderBy(x)) - F.col(x)
    rows = df.where(F.col(x).isNotNull()).withColumn("__gap", gap)
    psi = elementwise(np.vectorize(digamma, otypes=[float]))
    out = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.avg(_ln(F.col("__gap"))).alias("mean"))
    return out.where(F.col("n") > k).select(*keys, (psi(F.col("n")) - digamma(k) + F.col("mean")).alias("differential_entropy"))


def bin_index(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin by rounding to the nearest of ``bins`` levels."""
    at = F.round((x - low) / F.when(high > low, high - low).otherwise(1.0) * (bins - 1))
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(bins - 1))).cast("int")


def mutual_information(df: DataFrame, x: str, y: str, by=(), bins: int = 10, base: float | None = None) -> DataFrame:
    """From the joint histogram of two binned columns; never below zero. Windows see at most bins**2 rows a group."""
    keys = _by(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    joined = rows.join(ends, keys) if keys else rows.crossJoin(F.broadcast(ends))  # one row
    joint = joined.groupBy(*keys, bin_index(F.col(x), F.col("x0"), F.col("x1"), bins).alias("i"), bin_index(F.col(y), F.col("y0"), F.col("y1"), bins).alias("j")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    own = (F.col("n") / total).alias("p"), (F.sum("n").over(Window.partitionBy(*keys, "i")) / total).alias("px"), (F.sum("n").over(Window.partitionBy(*keys, "j")) / total).alias("py")
    mi = F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))) / _scale(base)
    return joint.select(*keys, *own).groupBy(*keys).agg(F.greatest(mi, F.lit(0.0)).alias("mutual_information"))
