"""Interpolation as bracket joins: knots and queries meet in one sorted stream a group.

The knots around a query are the last one before it and the first one after it, found by
two window frames over the union of both tables; no query is compared with all knots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators.splines import cubic_spline_coefficients, spline_slopes
from sparksci.operators.statistics import _by

__all__ = ["akima_slopes", "cubic_spline_coefficients", "hermite", "interp1d", "pchip_slopes", "secant_slopes", "spline_slopes"]


def _bracketed(knots: DataFrame, queries: DataFrame, x: str, values: list[str], xq: str, by) -> DataFrame:
    """queries with the structs ``a`` and ``b``: the knots at or before, and after, each query; end segments extend outwards."""
    keys = _by(by)
    w = Window.partitionBy(*keys).orderBy(x)
    fields = F.struct(F.col(x).cast("double").alias("at"), *(F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)))
    k = knots.select(*keys, F.col(x).cast("double").alias("__x"), fields.alias("__k"), F.lead(fields).over(w).alias("__next"), F.lag(fields).over(w).alias("__prev"), F.lit(0).alias("__q"), F.lit(None).cast("string").alias("__id"))
    own = queries.withColumn("__row", F.struct(*queries.columns))
    q = own.select(*keys, F.col(xq).cast("double").alias("__x"), F.lit(1).alias("__q"), "__row")
    both = k.unionByName(q, allowMissingColumns=True)
    sweep = Window.partitionBy(*keys).orderBy("__x", "__q")
    last = lambda c: F.last(c, ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    # The next one is the last one met from the other end: such a frame grows row by row, one that shrinks is read anew for each row.
    back = Window.partitionBy(*keys).orderBy(F.desc("__x"), F.desc("__q"))
    first = lambda c: F.last(c, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    pair = F.struct(F.col("__prev").alias("p"), F.col("__k").alias("k"), F.col("__next").alias("n"))
    marked = both.withColumn("__pair", F.when(F.col("__q") == 0, pair))
    placed = marked.withColumn("__before", last("__pair")).withColumn("__after", first("__pair")).where("__q = 1")
    before, after = F.col("__before"), F.col("__after")
    a = F.when(before.isNull(), after["k"]).when(before["n"].isNull(), F.coalesce(before["p"], before["k"])).otherwise(before["k"])
    b = F.when(before.isNull(), F.coalesce(after["n"], after["k"])).when(before["n"].isNull(), before["k"]).otherwise(before["n"])
    return placed.select("__row.*", a.alias("__a"), b.alias("__b"))


def interp1d(knots: DataFrame, queries: DataFrame, x: str, y: str, xq: str, by=(), method: str = "linear", out: str = "value") -> DataFrame:
    """Values between knots; outside, the end segment goes on (linear, cubic) or the end value holds (nearest).

    A query halfway between two knots takes the right one (nearest). ``cubic`` joins the knots with the slopes of
    ``secant_slopes``; for splines see ``spline_slopes`` and ``hermite``.
    """
    if method == "cubic":
        return hermite(secant_slopes(knots, x, y, by, "__slope"), queries, x, y, "__slope", xq, by, out)
    rows = _bracketed(knots, queries, x, [y], xq, by)
    a, b, q = F.col("__a"), F.col("__b"), F.col(xq).cast("double")
    if method == "linear":
        value = F.when(b["at"] == a["at"], a["v0"]).otherwise(a["v0"] + (b["v0"] - a["v0"]) * (q - a["at"]) / (b["at"] - a["at"]))
    elif method == "nearest":
        value = F.when(F.abs(q - a["at"]) < F.abs(b["at"] - q), a["v0"]).otherwise(b["v0"])
    else:
        raise ValueError("method is linear, nearest or cubic; for other smooth curves see hermite")
    return rows.withColumn(out, value).drop("__a", "__b")


def pchip_slopes(df: DataFrame, x: str, y: str, by=(), out: str = "slope") -> DataFrame:
    """Shape-preserving slopes: weighted harmonic means of the neighbouring secants, 0 where these differ in sign."""
    w = Window.partitionBy(*_by(by)).orderBy(x)
    h = lambda k: F.lead(x, k + 1).over(w) - (F.lead(x, k).over(w) if k else F.col(x)) if k >= 0 else (F.lag(x, -k - 1).over(w) if k < -1 else F.col(x)) - F.lag(x, -k).over(w)
    d = lambda k: F.lead(y, k + 1).over(w) - (F.lead(y, k).over(w) if k else F.col(y)) if k >= 0 else (F.lag(y, -k - 1).over(w) if k < -1 else F.col(y)) - F.lag(y, -k).over(w)
    rows = df
    for k in (-2, -1, 0, 1):
        rows = rows.withColumn(f"__h{k + 2}", h(k)).withColumn(f"__s{k + 2}", d(k) / h(k))
    h0, h1, s0, s1 = F.col("__h1"), F.col("__h2"), F.col("__s1"), F.col("__s2")
    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    inner = F.when(s0 * s1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / s0 + w2 / s1))

    def end(ha, hb, sa, sb):
        m = ((2 * ha + hb) * sa - ha * sb) / (ha + hb)
        kept = F.when(m * sa <= 0, 0.0).when((sa * sb <= 0) & (F.abs(m) > 3 * F.abs(sa)), 3 * sa).otherwise(m)
        return F.when(sb.isNull(), sa).otherwise(kept)

    left = end(h1, F.col("__h3"), s1, F.col("__s3"))
    right = end(h0, F.col("__h0"), s0, F.col("__s0"))
    slope = F.when(s0.isNull(), F.coalesce(left, F.lit(0.0))).when(s1.isNull(), right).otherwise(inner)
    return rows.withColumn(out, slope).drop(*(f"__{c}{k}" for c in "hs" for k in range(4)))


def akima_slopes(df: DataFrame, x: str, y: str, by=(), out: str = "slope") -> DataFrame:
    """Slopes weighted by how much the secants on the other side turn; secants are extended linearly beyond the ends."""
    w = Window.partitionBy(*_by(by)).orderBy(x)
    m = (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))
    rows = df.withColumn("__m2", m).withColumn("__m1", F.lag("__m2", 1).over(w)).withColumn("__m0", F.lag("__m2", 2).over(w)).withColumn("__m3", F.lead("__m2", 1).over(w))
    m0, m1, m2, m3 = (F.col(f"__m{k}") for k in range(4))
    # Ends: from the inside out, each missing secant goes on from the two next to it.
    e2 = F.coalesce(m2, F.when(m0.isNotNull(), 2 * m1 - m0), m1)
    e1 = F.coalesce(m1, F.when(m3.isNotNull(), 2 * m2 - m3), m2)
    e3 = F.coalesce(m3, 2 * e2 - e1)
    e0 = F.coalesce(m0, 2 * e1 - e2)
    a, b = F.abs(e3 - e2), F.abs(e1 - e0)
    return rows.withColumn(out, F.when(a + b > 0, (a * e1 + b * e2) / (a + b)).otherwise((e1 + e2) / 2)).drop("__m0", "__m1", "__m2", "__m3")


def secant_slopes(df: DataFrame, x: str, y: str, by=(), out: str = "slope") -> DataFrame:
    """Knots with the mean slope of the lines to both neighbours; at an end that of the only one, 0 for a single knot."""
    w = Window.partitionBy(*_by(by)).orderBy(x)
    ahead = F.try_divide(F.lead(y).over(w) - F.col(y), F.lead(x).over(w) - F.col(x))
    steep = df.withColumn("__ahead", ahead).withColumn("__behind", F.lag("__ahead").over(w))
    mean = (F.coalesce("__ahead", "__behind") + F.coalesce("__behind", "__ahead")) / 2
    return steep.withColumn(out, F.coalesce(mean, F.lit(0.0))).drop("__ahead", "__behind")


def hermite(knots: DataFrame, queries: DataFrame, x: str, y: str, slope: str, xq: str, by=(), out: str = "value") -> DataFrame:
    """Cubic Hermite values from knots with slopes (of pchip_slopes or akima_slopes)."""
    rows = _bracketed(knots, queries, x, [y, slope], xq, by)
    a, b, q = F.col("__a"), F.col("__b"), F.col(xq).cast("double")
    h = b["at"] - a["at"]
    t = F.try_divide(q - a["at"], h)
    value = (
        (2 * t**3 - 3 * t**2 + 1) * a["v0"] + (t**3 - 2 * t**2 + t) * h * a["v1"] + (3 * t**2 - 2 * t**3) * b["v0"] + (t**3 - t**2) * h * b["v1"]
    )
    return rows.withColumn(out, F.when(h == 0, a["v0"]).otherwise(value)).drop("__a", "__b")
