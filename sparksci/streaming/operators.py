"""Windowed statistics, recursive filters with carried state, and mini-batch clustering over streams.

The batch and the streaming filter share one step, so a series filtered in pieces
equals the series filtered at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparksci.operators.cluster import _assigned_sums


def windowed_statistics(stream: DataFrame, ts: str, x: str, by=(), window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, mean, deviation and extremes of event-time windows; rows later than ``late`` are left out."""
    keys = [by] if isinstance(by, str) else list(by)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        stream.withWatermark(ts, late)
        .groupBy(w.alias("window"), *keys)
        .agg(F.count(x).alias("nobs"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "nobs", "mean", "std", "min", "max")
    )


def _step(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and next state of a recursive filter whose state holds the pending sums."""
    y, z = np.empty(len(x)), z.copy()
    for i, v in enumerate(x.tolist()):
        y[i] = b[0] * v + z[0]
        z[:-1] = z[1:]
        z[-1] = 0.0
        z += b[1:] * v - a[1:] * y[i]
    return y, z


def _coefficients(b, a) -> tuple[np.ndarray, np.ndarray]:
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    if a[0] == 0:
        raise ValueError("the first denominator coefficient is zero")
    n = max(len(a), len(b), 2)
    return np.pad(b / a[0], (0, n - len(b))), np.pad(a / a[0], (0, n - len(a)))


def lfilter(df: DataFrame, x: str, order: str, by: str, b, a) -> DataFrame:
    """(by, order, y): every series filtered in its order. One series meets in one task, sample after sample as defined."""
    b, a = _coefficients(b, a)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        return pd.DataFrame({by: pdf["key"], order: pdf["t"], "y": _step(b, a, pdf["x"].to_numpy(float), np.zeros(len(b) - 1))[0]})

    rows = df.select(F.col(by).alias("key"), F.col(order).alias("t"), F.col(x).cast("double").alias("x"))
    kinds = dict(rows.dtypes)
    return rows.groupBy("key").applyInPandas(run, f"`{by}` {kinds['key']}, `{order}` {kinds['t']}, y double")


def sosfilt(df: DataFrame, x: str, order: str, by: str, sections: list[list[float]]) -> DataFrame:
    """A cascade of second-order sections (b0, b1, b2, a0, a1, a2)."""
    out = df
    for s in sections:
        out = lfilter(out, x, order, by, s[:3], s[3:]).withColumnRenamed("y", x)
    return out.withColumnRenamed(x, "y")


def lfilter_stream(stream: DataFrame, x: str, order: str, by: str, b, a) -> DataFrame:
    """As ``lfilter`` over a stream: each series' filter state is kept between batches; rows come in order within a series."""
    b, a = _coefficients(b, a)
    rows = stream.select(F.col(by).alias("key"), F.col(order).alias("t"), F.col(x).cast("double").alias("x"))
    kinds = dict(rows.dtypes)

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        z = np.array(state.get[0]) if state.exists else np.zeros(len(b) - 1)
        pdf = pd.concat(list(batches)).sort_values("t", kind="stable")
        y, z = _step(b, a, pdf["x"].to_numpy(float), z)
        state.update((z.tolist(),))
        yield pd.DataFrame({by: pdf["key"], order: pdf["t"], "y": y})

    return rows.groupBy("key").applyInPandasWithState(
        run, f"`{by}` {kinds['key']}, `{order}` {kinds['t']}, y double", "z array<double>", "append", GroupStateTimeout.NoTimeout
    )


class MiniBatchKMeans:
    """Centres that move by each batch's means with a rate of its share of all points so far; for ``foreachBatch``."""

    def __init__(self, centers: list[list[float]]):
        self.centers, self.seen = np.array(centers, float), np.zeros(len(centers))

    def update(self, batch: DataFrame, epoch: int = 0) -> None:
        """batch: (id, v). A row a centre reaches the driver."""
        dims = F.array(*(F.sum(F.col("total")[j]) for j in range(self.centers.shape[1])))
        for r in _assigned_sums(batch, self.centers).groupBy("label").agg(F.sum("n").alias("n"), dims.alias("total")).collect():
            if r["n"]:
                k = r["label"]
                self.seen[k] += r["n"]
                self.centers[k] += (np.array(r["total"]) - r["n"] * self.centers[k]) / self.seen[k]
