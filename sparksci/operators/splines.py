"""Cubic splines through any number of knots: one tridiagonal system a group, spread over tasks.

Cyclic reduction: an odd row takes its two even neighbours in, which leaves half of the
rows; once a group is small, one task solves it, and the even rows follow from the odd
ones, level by level.  Rows meet their neighbours by an exchange on (group, index), so a
long series is spread evenly; all levels together move twice the rows of the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksci.operators.statistics import _beside, _by, ranks
from sparksci.sources.tables import forget, stored

#: Rows of a group that one task solves at once.
DIRECT = 4096
ENDS = ("natural", "clamped", "not-a-knot")


def _sent(rows: DataFrame, keys: list[str], to: dict[str, Column], what: Column) -> DataFrame:
    """(keys, i, one column a role): ``what`` of each row, sent to the indices in ``to`` by role; null where nobody sent."""
    copies = F.explode(F.array(*(F.struct(at.alias("i"), F.lit(role).alias("role")) for role, at in to.items())))
    out = rows.select(*keys, what.alias("what"), copies.alias("to")).select(*keys, "what", "to.i", "to.role").where("i IS NOT NULL")
    return out.groupBy(*keys, "i").agg(*(F.first(F.when(F.col("role") == role, F.col("what")), ignorenulls=True).alias(role) for role in to))


def _halved(rows: DataFrame, keys: list[str]) -> DataFrame:
    odd = F.col("i") % 2 == 1
    equation = F.struct("lo", "mid", "up", "rhs")
    met = _sent(rows, keys, {"own": F.when(odd, F.col("i")), "left": F.when(~odd, F.col("i") + 1), "right": F.when(~odd, F.col("i") - 1)}, equation).where("own IS NOT NULL")
    own, left, right = F.col("own"), F.col("left"), F.col("right")
    p, q = F.try_divide(-own["lo"], left["mid"]), F.when(right.isNull(), 0.0).otherwise(F.try_divide(-own["up"], right["mid"]))
    of = lambda name: F.coalesce(right[name], F.lit(0.0))
    return met.select(
        *keys, ((F.col("i") - 1) / 2).cast("long").alias("i"), (p * left["lo"]).alias("lo"), (own["mid"] + p * left["up"] + q * of("lo")).alias("mid"), (q * of("up")).alias("up"), (own["rhs"] + p * left["rhs"] + q * of("rhs")).alias("rhs")
    )


def _followed(rows: DataFrame, solved: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, s) of a level from those of its odd rows."""
    odd = solved.select(*keys, (2 * F.col("i") + 1).alias("i"), "s")
    known = odd.select(*keys, "i", "s", F.lit(None).cast("struct<lo:double,mid:double,up:double,rhs:double>").alias("e"))
    even = rows.where("i % 2 = 0").select(*keys, "i", F.lit(None).cast("double").alias("s"), F.struct("lo", "mid", "up", "rhs").alias("e"))
    asks = F.col("e").isNotNull()
    to = {"own": F.when(asks, F.col("i")), "left": F.when(~asks, F.col("i") + 1), "right": F.when(~asks, F.col("i") - 1)}
    met = _sent(even.unionByName(known), keys, to, F.struct("s", "e")).where("own IS NOT NULL")
    e = F.col("own.e")
    value = e["rhs"] - e["lo"] * F.coalesce("left.s", F.lit(0.0)) - e["up"] * F.coalesce("right.s", F.lit(0.0))
    return odd.unionByName(met.select(*keys, "i", F.try_divide(value, e["mid"]).alias("s")))


def tridiagonal(rows: DataFrame, by=(), direct: int = DIRECT) -> DataFrame:
    """(by, i, s): solutions of lo * s[i-1] + mid * s[i] + up * s[i+1] = rhs, for rows (by, i, lo, mid, up, rhs), i from 0 without gaps.

    Meant for systems whose middle outweighs the sides: no pivots are sought, a zero one gives nulls or NaN.
    """
    keys = _by(by)
    kinds = dict(rows.dtypes)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        lo, mid, up, rhs = (pdf[c].to_numpy(float).copy() for c in ("lo", "mid", "up", "rhs"))
        with np.errstate(all="ignore"):
            for i in range(1, len(mid)):
                part = lo[i] / mid[i - 1]
                mid[i] -= part * up[i - 1]
                rhs[i] -= part * rhs[i - 1]
            s = rhs / mid
            for i in range(len(mid) - 2, -1, -1):
                s[i] -= up[i] * s[i + 1] / mid[i]
        return pdf[[*keys, "i"]].assign(s=s)

    now, levels = stored(rows.select(*keys, F.col("i").cast("long").alias("i"), *(F.col(c).cast("double").alias(c) for c in ("lo", "mid", "up", "rhs")))), []
    while (now.agg(F.max("i")).first()[0] or 0) >= direct:
        levels.append(now)
        now = stored(_halved(now, keys))
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "i long, s double"
    solved = stored(now.groupBy(*keys).applyInPandas(solve, schema))
    forget(now)
    for level in reversed(levels):
        longer = stored(_followed(level, solved, keys))
        forget(level, solved)
        solved = longer
    return solved


def _knots(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, i, n, x, y): a group's knots, numbered by x; of several at one x the least y; groups of one are left out."""
    at = df.select(*(F.col(k).alias(f"__k{j}") for j, k in enumerate(keys)), (F.col(x).cast("double") + 0.0).alias("x"), F.col(y).cast("double").alias("y"))
    at = at.where("abs(x) < double('inf') AND abs(y) < double('inf')")
    inner = [f"__k{j}" for j in range(len(keys))]
    placed = ranks(at.groupBy(*inner, "x").agg(F.min("y").alias("y")), "x", inner, out="i").withColumn("i", F.col("i") - 1)
    sized = _beside(placed, placed.groupBy(*inner).agg(F.count("*").alias("n")), inner)
    return stored(sized.where("n > 1").select(*inner, F.col("i").cast("long").alias("i"), "n", "x", "y"))


def _system(knots: DataFrame, keys: list[str], bc: str, slopes: tuple[float, float]) -> DataFrame:
    """Rows of the second derivatives' system; without the two ends for not-a-knot, whose condition is put into the rows beside them."""
    met = _sent(knots, keys, {"own": F.col("i"), "prev": F.col("i") + 1, "next": F.col("i") - 1}, F.struct("n", "x", "y")).where("own IS NOT NULL")
    n, i = F.col("own.n"), F.col("i")
    h, g = F.col("own.x") - F.col("prev.x"), F.col("next.x") - F.col("own.x")
    before, after = F.try_divide(F.col("own.y") - F.col("prev.y"), h), F.try_divide(F.col("next.y") - F.col("own.y"), g)
    zero, one = F.lit(0.0), F.lit(1.0)
    row = lambda lo, mid, up, rhs: F.struct(lo.alias("lo"), mid.alias("mid"), up.alias("up"), rhs.alias("rhs"))
    inner = row(h, 2 * (h + g), g, 6 * (after - before))
    first, last = i == 0, i == n - 1
    if bc == "natural":
        e = F.when(first | last, row(zero, one, zero, zero)).otherwise(inner)
    elif bc == "clamped":
        e = F.when(first, row(zero, 2 * g, g, 6 * (after - slopes[0]))).when(last, row(h, 2 * h, zero, 6 * (slopes[1] - before))).otherwise(inner)
    else:
        right = 6 * (after - before)
        e = F.when(n == 3, row(zero, 3 * (h + g), zero, right))
        e = e.when(i == 1, row(zero, (h + g) * (h + 2 * g) / g, (g - h) * (g + h) / g, right))
        e = e.when(i == n - 2, row((h - g) * (h + g) / h, (h + g) * (g + 2 * h) / h, zero, right)).otherwise(inner)
        met, i = met.where(~first & ~last), i - 1
    return met.select(*keys, i.alias("i"), e.alias("e")).select(*keys, "i", "e.*")


def _bent(df: DataFrame, x: str, y: str, keys: list[str], bc: str, slopes: tuple[float, float], direct: int) -> tuple[DataFrame, list[str]]:
    """(inner keys, i, own, prev, next), each a struct (n, x, y, m) with m the second derivative."""
    if bc not in ENDS:
        raise ValueError(f"bc is one of {', '.join(ENDS)}")
    inner = [f"__k{j}" for j in range(len(keys))]
    knots = _knots(df, x, y, keys)
    found = tridiagonal(_system(knots, inner, bc, slopes), inner, direct)
    shift = 1 if bc == "not-a-knot" else 0
    m = F.col("m")
    both = knots.select(*inner, "i", "n", "x", "y", F.lit(None).cast("double").alias("m")).unionByName(found.select(*inner, (F.col("i") + shift).alias("i"), F.col("s").alias("m")), allowMissingColumns=True)
    whole = stored(both.groupBy(*inner, "i").agg(*(F.max(c).alias(c) for c in ("n", "x", "y", "m"))))
    forget(knots, found)
    to = {"own": F.col("i"), "prev": F.col("i") + 1, "next": F.col("i") - 1}
    if bc == "not-a-knot":
        met = _sent(whole.where("n > 2"), inner, to, F.struct("n", "x", "y", "m")).where("own IS NOT NULL")
        h, g, n = F.col("own.x") - F.col("prev.x"), F.col("next.x") - F.col("own.x"), F.col("own.n")
        own = F.col("own.m")
        start = F.when(n == 3, own).otherwise(((h + g) * own - h * F.col("next.m")) / g)
        end = F.when(n == 3, own).otherwise(((h + g) * own - g * F.col("prev.m")) / h)
        ends = met.select(*inner, F.explode(F.array(F.when(F.col("i") == 1, F.struct(F.lit(0).cast("long").alias("i"), start.alias("m"))), F.when(F.col("i") == n - 2, F.struct((n - 1).alias("i"), end.alias("m"))))).alias("e"))
        more = whole.unionByName(ends.where("e IS NOT NULL").select(*inner, "e.*"), allowMissingColumns=True)
        filled = stored(more.groupBy(*inner, "i").agg(*(F.max(c).alias(c) for c in ("n", "x", "y", "m"))).withColumn("m", F.when(F.col("n") == 2, 0.0).otherwise(m)))
        forget(whole)
        whole = filled
    return _sent(whole, inner, to, F.struct("n", "x", "y", "m")).where("own IS NOT NULL"), inner


def cubic_spline_coefficients(df: DataFrame, x: str, y: str, by=(), bc: str = "natural", slopes: tuple[float, float] = (0.0, 0.0), direct: int = DIRECT) -> DataFrame:
    """(by, segment, x0, a, b, c, d): y = a + b t + c t^2 + d t^3 for t = x - x0 between neighbouring knots.

    bc is natural (second derivative 0 at the ends), clamped (the given slopes there) or not-a-knot (one cubic over the first two
    segments, one over the last two; a parabola through three knots, a line through two).  Rows with a null, NaN or infinite x
    or y are left out; of several knots at one x the least y counts; a group of fewer than two knots has no segment.
    """
    keys = _by(by)
    met, inner = _bent(df, x, y, keys, bc, slopes, direct)
    own, after = F.col("own"), F.col("next")
    h = after["x"] - own["x"]
    slope = (after["y"] - own["y"]) / h
    names = [F.col(j).alias(k) for j, k in zip(inner, keys, strict=True)]
    return met.where("next IS NOT NULL").select(
        *names, F.col("i").alias("segment"), own["x"].alias("x0"), own["y"].alias("a"), (slope - h * (2 * own["m"] + after["m"]) / 6).alias("b"), (own["m"] / 2).alias("c"), ((after["m"] - own["m"]) / (6 * h)).alias("d")
    )


def spline_slopes(df: DataFrame, x: str, y: str, by=(), bc: str = "not-a-knot", slopes: tuple[float, float] = (0.0, 0.0), out: str = "slope", direct: int = DIRECT) -> DataFrame:
    """(by, x, y, slope): the knots with the spline's slopes; ``interpolate.hermite`` on these draws the spline."""
    keys = _by(by)
    met, inner = _bent(df, x, y, keys, bc, slopes, direct)
    own, after, before = F.col("own"), F.col("next"), F.col("prev")
    h, g = after["x"] - own["x"], own["x"] - before["x"]
    ahead = (after["y"] - own["y"]) / h - h * (2 * own["m"] + after["m"]) / 6
    behind = (own["y"] - before["y"]) / g + g * (before["m"] + 2 * own["m"]) / 6
    names = [F.col(j).alias(k) for j, k in zip(inner, keys, strict=True)]
    return met.select(*names, own["x"].alias(x), own["y"].alias(y), F.when(after.isNotNull(), ahead).otherwise(behind).alias(out))
