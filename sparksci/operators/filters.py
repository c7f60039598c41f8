"""Recursive filters of long series, forwards and both ways, by an associative scan.

A series is cut into blocks.  Filtering a block is an affine map of the filter's state:
the block's own end state from rest plus a fixed matrix times the state before it.  The
maps are composed by doubling (a round joins each block with the one 2**r before it),
then every block is filtered from its true start.  One series so spreads over many
tasks; rounds grow with the logarithm of its number of blocks.

Rows without value or order take no part; series and blocks may be of any length.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksci.operators.statistics import _by, ranks
from sparksci.sources.tables import forget, stored

#: Samples of a block.
BLOCK = 1 << 14


def coefficients(b, a) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of one length, divided by the denominator's first coefficient."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    if a[0] == 0:
        raise ValueError("the first denominator coefficient is zero")
    n = max(len(a), len(b), 2)
    return np.pad(b / a[0], (0, n - len(b))), np.pad(a / a[0], (0, n - len(a)))


def _steps(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x filtered side by side from the states z (rows x pending sums): outputs and end states."""
    y, z = np.empty_like(x), z.copy()
    for t in range(x.shape[1]):
        y[:, t] = b[0] * x[:, t] + z[:, 0]
        z[:, :-1] = z[:, 1:]
        z[:, -1] = 0.0
        z += x[:, t, None] * b[1:] - y[:, t, None] * a[1:]
    return y, z


class Cascade:
    """Sections (b, a) one behind the other; the state is all their pending sums."""

    def __init__(self, sections: list[tuple]):
        self.sections = [coefficients(b, a) for b, a in sections]
        self.sizes = [len(b) - 1 for b, _ in self.sections]
        self.size = sum(self.sizes)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output and end state of one stretch, in about 2 sqrt(n) array steps a section."""
        ends, at = [], 0
        for (b, a), size in zip(self.sections, self.sizes, strict=True):
            z, at = state[at : at + size].copy(), at + size
            width = math.isqrt(len(x))
            rows = len(x) // width if width else 0
            parts = []
            if rows:
                # All rows from rest, then the states that really precede them and what these add.
                y, out = _steps(b, a, x[: rows * width].reshape(rows, width), np.zeros((rows, size)))
                ring, carry = _steps(b, a, np.zeros((size, width)), np.eye(size))
                starts = np.empty((rows, size))
                for r in range(rows):
                    starts[r] = z
                    z = z @ carry + out[r]
                parts.append((y + starts @ ring).ravel())
            if rows * width < len(x):
                y, z = _steps(b, a, x[None, rows * width :], z[None])
                parts.append(y[0])
                z = z[0]
            x = np.concatenate(parts) if parts else x
            ends.append(z)
        return x, np.concatenate(ends) if ends else np.empty(0)

    def carried(self, n: int) -> np.ndarray:
        """Row j: what a unit in place j of the state has become n samples later."""
        return np.stack([self.run(np.zeros(n), row)[1] for row in np.eye(self.size)]) if self.size else np.empty((0, 0))


def _same(keys: list[str], a: DataFrame, b: DataFrame, more) -> DataFrame:
    """a with b's other columns, keys equal also where null; b's keys are named with an underscore before."""
    named = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [more]), "left").drop(*(f"_{k}" for k in keys))


def scan(rows: DataFrame, keys: list[str], cascade: Cascade) -> DataFrame:
    """(keys, pos, t, y) of rows (keys, pos, t, x) with pos counting from 0 in each series."""
    if not cascade.sections:
        return rows.withColumnRenamed("x", "y")
    size = BLOCK
    packed = rows.groupBy(*keys, F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "t"))).alias("__s"))
    blocks = stored(packed.select(*keys, "block", F.col("__s.x").alias("x"), F.col("__s.t").alias("t")))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [cascade.run(np.asarray(x, float), np.zeros(cascade.size))[1] for x in pdf["x"]]
            yield pdf.drop(columns="x").assign(state=out)

    kinds = dict(blocks.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "block"])
    held = stored(blocks.select(*keys, "block", "x").mapInPandas(ends, schema + ", state array<double>"))
    last, reach, carry = held.agg(F.max("block")).first()[0] or 0, 1, cascade.carried(size)
    while reach <= last:
        before = held.select(*keys, (F.col("block") + reach).alias("at"), F.col("state").alias("ahead"))
        plus = F.array(*(F.get("state", F.lit(j)) + functools.reduce(lambda s, i: s + F.get("ahead", F.lit(i)) * float(carry[i, j]), range(cascade.size), F.lit(0.0)) for j in range(cascade.size)))  # noqa: B023
        new = stored(_same(keys, held, before, F.col("block") == F.col("at")).select(*keys, "block", F.when(F.col("ahead").isNull(), F.col("state")).otherwise(plus).alias("state")))
        forget(held)
        held, reach, carry = new, 2 * reach, carry @ carry
    starts = held.select(*keys, (F.col("block") + 1).alias("at"), F.col("state").alias("start"))

    def outputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [cascade.run(np.asarray(x, float), np.zeros(cascade.size) if z is None else np.asarray(z, float))[0] for x, z in zip(pdf["x"], pdf["start"], strict=True)]
            yield pdf.drop(columns=["x", "start"]).assign(y=out)

    begun = _same(keys, blocks, starts, F.col("block") == F.col("at")).select(*keys, "block", "x", "t", "start")
    done = begun.mapInPandas(outputs, f"{schema}, t {kinds['t']}, y array<double>")
    each = done.select(*keys, "block", F.posexplode(F.arrays_zip("t", "y")).alias("__i", "__r"))
    return each.select(*keys, (F.col("block") * size + F.col("__i")).alias("pos"), F.col("__r.t").alias("t"), F.col("__r.y").alias("y"))


def _placed(df: DataFrame, x: str, order: str, by) -> tuple[DataFrame, list[str]]:
    keys = _by(by)
    held = df.where(F.col(x).isNotNull() & F.col(order).isNotNull()).select(*keys, F.col(order).alias("t"), F.col(x).cast("double").alias("x"))
    return ranks(held, "t", keys, out="pos").select(*keys, (F.col("pos") - 1).alias("pos"), "t", "x"), keys


def _filtered(df: DataFrame, x: str, order: str, by, cascade: Cascade) -> DataFrame:
    rows, keys = _placed(df, x, order, by)
    return scan(rows, keys, cascade).select(*keys, F.col("t").alias(order), "y")


def lfilter(df: DataFrame, x: str, order: str, b, a, by=()) -> DataFrame:
    """(by, order, y): a recursive filter b / a from rest."""
    return _filtered(df, x, order, by, Cascade([(b, a)]))


def sosfilt(df: DataFrame, x: str, order: str, sections: list[list[float]], by=()) -> DataFrame:
    """(by, order, y): second-order sections (b0, b1, b2, a0, a1, a2) from rest; one scan carries the state of all."""
    return _filtered(df, x, order, by, Cascade([(s[:3], s[3:]) for s in sections]))


PADS = ("odd", "even", "constant", "none")


def _both_ways(df: DataFrame, x: str, order: str, by, cascade: Cascade, pad: int, kind: str) -> DataFrame:
    if kind not in PADS:
        raise ValueError(f"padtype is one of {', '.join(PADS)}")
    rows, keys = _placed(df, x, order, by)
    rows = stored(rows)
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("pos") == 0, F.col("x"))).alias("first"), F.max_by("x", "pos").alias("last")))
    width = 0 if kind == "none" else pad
    held = _same(keys, rows, sizes, F.lit(True)).where(F.col("n") > pad)
    p, n = F.col("pos"), F.col("n")
    value = lambda end: {"odd": 2 * F.col(end) - F.col("x"), "even": F.col("x")}.get(kind, F.col(end))
    left = F.when((p >= 1) & (p <= width), F.struct((F.lit(width) - p).alias("pos"), F.lit(None).alias("t"), value("first").alias("x")))
    right = F.when((n - 1 - p >= 1) & (n - 1 - p <= width), F.struct((width + 2 * (n - 1) - p).alias("pos"), F.lit(None).alias("t"), value("last").alias("x")))
    own = F.struct((p + width).alias("pos"), F.col("t"), F.col("x"))
    kinds = dict(rows.dtypes)
    shape = f"array<struct<pos:bigint,t:{kinds['t']},x:double>>"
    every = F.explode(F.filter(F.array(own, left, right).cast(shape), lambda r: r.isNotNull()))
    padded = held.select(*keys, "n", every.alias("__r")).select(*keys, "n", "__r.pos", "__r.t", "__r.x")
    if kind == "constant" and width:
        # End values repeat as often as the ends are long, whatever the rows next to them.
        padded = padded.where(F.col("t").isNotNull())
        more = sizes.where(F.col("n") > pad).select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("__i"), "first", "last")
        ends = F.explode(F.array(F.struct(F.col("__i").cast("long").alias("pos"), F.col("first").alias("x")), F.struct((F.col("__i") + width + F.col("n")).alias("pos"), F.col("last").alias("x"))))
        padded = padded.unionByName(more.select(*keys, "n", ends.alias("__r")).select(*keys, "n", "__r.pos", F.lit(None).cast(kinds["t"]).alias("t"), "__r.x"))
    total = sizes.select(*keys, (F.col("n") + (2 * width - 1)).alias("end"))

    def backwards(out: DataFrame) -> DataFrame:
        return _same(keys, out, total, F.lit(True)).select(*keys, (F.col("end") - F.col("pos")).alias("pos"), "t", F.col("y").alias("x"))

    ahead = scan(padded.select(*keys, "pos", "t", "x"), keys, cascade)
    done = scan(backwards(ahead), keys, cascade)
    return done.where(F.col("t").isNotNull()).select(*keys, F.col("t").alias(order), "y")


def filtfilt(df: DataFrame, x: str, order: str, b, a, by=(), padtype: str = "odd", padlen: int | None = None) -> DataFrame:
    """(by, order, y): filtered forwards and then backwards, so without delay. Ends are extended by padlen values.

    padlen is three times the longer of b and a unless given. Series that are not longer than padlen give no rows.
    """
    longest = max(len(np.atleast_1d(b)), len(np.atleast_1d(a)))
    return _both_ways(df, x, order, by, Cascade([(b, a)]), 3 * longest if padlen is None else padlen, padtype)


def sosfiltfilt(df: DataFrame, x: str, order: str, sections: list[list[float]], by=(), padtype: str = "odd", padlen: int | None = None) -> DataFrame:
    """As ``filtfilt`` for second-order sections; padlen is six times their number unless given."""
    return _both_ways(df, x, order, by, Cascade([(s[:3], s[3:]) for s in sections]), 6 * len(sections) if padlen is None else padlen, padtype)
