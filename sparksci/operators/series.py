"""Series operators: a column over ordered rows, for any number of series (``by``).

Filters, integrals, extrema and differences are window frames over (by, order); each
series is sorted once and streams through its task.  Boundary modes pad the ends from
the series itself.  Spectral transforms need a whole segment at once and run on arrays
of bounded length, one segment a row.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.functions import windows
from sparksci.operators.statistics import _by
from sparksci.sources.tables import settled


def _window(by, order):
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*_by(by)).orderBy(*order)


def _frame(by, order, before: int, after: int):
    return _window(by, order).rowsBetween(-before, after)


def _odd(size: int) -> int:
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be odd")
    return size // 2


# --- integrals -----------------------------------------------------------------------------


def trapezoid(df: DataFrame, y: str, x: str, by=(), order=None) -> DataFrame:
    """Area under y over x by the trapezoidal rule; 0 for a single point."""
    w = _window(by, order or x)
    part = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("__part", part).groupBy(*_by(by)).agg(F.coalesce(F.sum("__part"), F.lit(0.0)).alias("integral"))


def cumulative_trapezoid(df: DataFrame, y: str, x: str, by=(), order=None, out: str = "cumulative") -> DataFrame:
    """Running integral, 0 at the first point."""
    w = _window(by, order or x)
    part = F.coalesce((F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w)), F.lit(0.0))
    return df.withColumn("__part", part).withColumn(out, F.sum("__part").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__part")


def simpson(df: DataFrame, y: str, x: str, by=(), order=None) -> DataFrame:
    """Simpson's rule for unequal steps over pairs of intervals; an odd last interval by the trapezoidal rule."""
    keys, w = _by(by), _window(by, order or x)
    rows = df.select(*keys, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.row_number().over(w).alias("i"), *(f(c, k).over(w).alias(f"{n}{k}") for k in (1, 2) for c, n, f in ((x, "x", F.lead), (y, "y", F.lead))))
    h0, h1 = F.col("x1") - F.col("x0"), F.col("x2") - F.col("x1")
    over = F.try_divide  # equal abscissae make a pair of intervals null
    pair = (h0 + h1) / 6 * ((2 - over(h1, h0)) * F.col("y0") + over((h0 + h1) ** 2, h0 * h1) * F.col("y1") + (2 - over(h0, h1)) * F.col("y2"))
    single = (F.col("y0") + F.col("y1")) / 2 * h0
    part = F.when(F.col("i") % 2 == 1, F.when(F.col("x2").isNotNull(), pair).when(F.col("x1").isNotNull(), single))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("integral"))


# --- neighbourhood filters -----------------------------------------------------------------


def medfilt(df: DataFrame, y: str, order, by=(), size: int = 3, out: str = "medfilt") -> DataFrame:
    """Running median; the window shrinks at the ends, and of an even number of values the upper one of the middle two is taken."""
    h = _odd(size)
    near = F.sort_array(F.collect_list(y).over(_frame(by, order, h, h)))
    return df.withColumn(out, F.get(near, F.floor(F.size(near) / 2).cast("int")))


def wiener(df: DataFrame, y: str, order, by=(), size: int = 3, noise: float | None = None, out: str = "wiener") -> DataFrame:
    """Adaptive smoothing by local mean and variance; the noise defaults to the least local variance."""
    h, keys = _odd(size), _by(by)
    near = _frame(by, order, h, h)
    rows = df.withColumn("__m", F.avg(y).over(near)).withColumn("__v", F.var_pop(y).over(near))
    level = F.greatest(F.min("__v").over(Window.partitionBy(*keys)), F.lit(1e-10)) if noise is None else F.lit(float(noise))
    gain = F.greatest(F.col("__v") - level, F.lit(0.0)) / F.greatest(F.col("__v"), level)
    return rows.withColumn(out, F.col("__m") + gain * (F.col(y) - F.col("__m"))).drop("__m", "__v")


def padded(df: DataFrame, y: str, order: str, by, pad: int, mode: str, constant: float = 0.0) -> DataFrame:
    """(by, __pos, __y, order): each series with ``pad`` more values at both ends.

    reflect leaves the end value out (d c b | a b c d | c b a), mirror repeats it (c b a | a b c d | d c b),
    nearest repeats the end value, wrap goes on at the other end, constant is a value. The added rows come from
    the first and last rows of a series only.
    """
    keys = _by(by)
    w = Window.partitionBy(*keys)
    rows = df.withColumn("__pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    base = rows.select(*keys, "__pos", "__n", F.col(y).cast("double").alias("__y"))
    p, n = F.col("__pos"), F.col("__n")
    if mode == "reflect":
        ends = [F.when((p >= 1) & (p <= pad), -p), F.when((p >= n - 1 - pad) & (p <= n - 2), 2 * n - 2 - p)]
    elif mode == "mirror":
        ends = [F.when(p < pad, -p - 1), F.when(p >= n - pad, 2 * n - 1 - p)]
    elif mode == "wrap":
        ends = [F.when(p >= n - pad, p - n), F.when(p < pad, p + n)]
    elif mode in ("nearest", "constant"):
        left = F.when(p == 0, F.sequence(F.lit(-pad), F.lit(-1)))
        right = F.when(p == n - 1, F.sequence(n, n + pad - 1))
        more = base.select(*keys, F.explode(F.concat(F.coalesce(left, F.array().cast("array<int>")).cast("array<long>"), F.coalesce(right, F.array().cast("array<long>")))).alias("__pos"), "__y")
        if mode == "constant":
            more = more.withColumn("__y", F.lit(float(constant)))
        return base.select(*keys, F.col("__pos").cast("long"), "__y").unionByName(more.select(*keys, F.col("__pos").cast("long"), "__y"))
    else:
        raise ValueError("mode is reflect, mirror, nearest, wrap or constant")
    more = base.select(*keys, F.explode(F.array(*ends)).alias("__pos"), "__y").where("__pos IS NOT NULL")
    return base.select(*keys, F.col("__pos").cast("long"), "__y").unionByName(more.select(*keys, F.col("__pos").cast("long"), "__y"))


def _filtered(df: DataFrame, y: str, order: str, by, before: int, after: int, mode: str, constant: float, value: Callable) -> DataFrame:
    """(by, pos, value) of a window aggregate over padded series, for the positions of the series themselves."""
    keys = _by(by)
    rows = padded(df, y, order, by, max(before, after), mode, constant).withColumn("value", value(Window.partitionBy(*keys).orderBy("__pos")))
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = rows.join(sizes, keys) if keys else rows.crossJoin(F.broadcast(sizes))  # one row
    return joined.where((F.col("__pos") >= 0) & (F.col("__pos") < F.col("__n"))).select(*keys, F.col("__pos").alias("pos"), "value")


def uniform_filter(df: DataFrame, y: str, order: str, by=(), size: int = 3, mode: str = "reflect", constant: float = 0.0) -> DataFrame:
    """Running mean of full windows over padded ends."""
    h = _odd(size)
    return _filtered(df, y, order, by, h, h, mode, constant, lambda w: F.avg("__y").over(w.rowsBetween(-h, h)))


def minimum_filter(df: DataFrame, y: str, order: str, by=(), size: int = 3, mode: str = "nearest", constant: float = 0.0) -> DataFrame:
    h = _odd(size)
    return _filtered(df, y, order, by, h, h, mode, constant, lambda w: F.min("__y").over(w.rowsBetween(-h, h)))


def maximum_filter(df: DataFrame, y: str, order: str, by=(), size: int = 3, mode: str = "nearest", constant: float = 0.0) -> DataFrame:
    h = _odd(size)
    return _filtered(df, y, order, by, h, h, mode, constant, lambda w: F.max("__y").over(w.rowsBetween(-h, h)))


def percentile_filter(df: DataFrame, y: str, order: str, p: float, by=(), size: int = 3, mode: str = "reflect") -> DataFrame:
    """The window's element at round(p / 100 (size - 1)), not interpolated."""
    h = _odd(size)
    at = round(p / 100 * (size - 1))
    return _filtered(df, y, order, by, h, h, mode, 0.0, lambda w: F.sort_array(F.collect_list("__y").over(w.rowsBetween(-h, h)))[at])


def _weighted(w, kernel: list[float], center: int) -> Column:
    """Sum of kernel[k] times the value k - center rows ahead: one expression for a short kernel."""
    terms = [F.lead("__y", k - center).over(w) * c if k != center else F.col("__y") * c for k, c in enumerate(kernel) if c]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    x = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    if order == 0:
        return g.tolist()
    factor = {1: -x / sigma**2, 2: x**2 / sigma**4 - 1 / sigma**2, 3: -(x**3) / sigma**6 + 3 * x / sigma**4}[order]
    return (factor * g).tolist()


def gaussian_filter(df: DataFrame, y: str, order: str, by=(), sigma: float = 1.0, derivative: int = 0, mode: str = "reflect", truncate: float = 4.0) -> DataFrame:
    kernel = gaussian_kernel(sigma, derivative, truncate)
    r = len(kernel) // 2
    return _filtered(df, y, order, by, r, r, mode, 0.0, lambda w: _weighted(w, kernel, r))


def correlate(df: DataFrame, y: str, order: str, kernel: list[float], by=(), mode: str = "full") -> DataFrame:
    """(by, pos, value): correlation with a short kernel."""
    return convolve(df, y, order, kernel[::-1], by, mode)


def convolve(df: DataFrame, y: str, order: str, kernel: list[float], by=(), mode: str = "full") -> DataFrame:
    """(by, pos, value): every value spreads over the positions that its kernel reaches, and positions add up.

    full has n + k - 1 values, same max(n, k) in the middle, valid max - min + 1 from k - 1 on. Map-side sums keep
    the shuffle at the size of the input.
    """
    keys, k = _by(by), len(kernel)
    if not k:
        raise ValueError("an empty kernel")
    rows = df.withColumn("__i", F.row_number().over(_window(by, order)) - 1)
    taps = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(c)).alias("c")) for j, c in enumerate(kernel)))
    spread = rows.select(*keys, "__i", F.col(y).cast("double").alias("__y"), F.explode(taps).alias("t"))
    full = spread.groupBy(*keys, (F.col("__i") + F.col("t.j")).alias("at")).agg(F.sum(F.col("__y") * F.col("t.c")).alias("value"))
    if mode == "full":
        return full.select(*keys, F.col("at").cast("long").alias("pos"), "value")
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    joined = full.join(n, keys) if keys else full.crossJoin(F.broadcast(n))  # one row
    if mode == "same":
        size, first = F.greatest(F.col("__n"), F.lit(k)), None
        first = F.floor((F.col("__n") + k - 1 - size) / 2)
    elif mode == "valid":
        size, first = F.abs(F.col("__n") - k) + 1, F.lit(k - 1)
    else:
        raise ValueError("mode is full, same or valid")
    at = F.col("at") - first
    return joined.where((at >= 0) & (at < size)).select(*keys, at.cast("long").alias("pos"), "value")


def savgol_coefficients(size: int, polyorder: int, deriv: int = 0, delta: float = 1.0) -> list[float]:
    h = _odd(size)
    if size < polyorder + 2 or deriv > polyorder:
        raise ValueError("the window must hold polyorder + 2 values and deriv may not exceed polyorder")
    x = np.arange(-h, h + 1, dtype=float)
    return (np.linalg.pinv(np.vander(x, polyorder + 1, increasing=True))[deriv] * math.factorial(deriv) / delta**deriv).tolist()


def savgol_filter(df: DataFrame, y: str, order: str, by=(), size: int = 5, polyorder: int = 2, deriv: int = 0, delta: float = 1.0) -> DataFrame:
    """Local polynomial fit as a fixed weighted window; ends reflected."""
    c = savgol_coefficients(size, polyorder, deriv, delta)
    return _filtered(df, y, order, by, size // 2, size // 2, "reflect", 0.0, lambda w: _weighted(w, c, size // 2))


# --- extrema -------------------------------------------------------------------------------


def argrel(df: DataFrame, y: str, order, by=(), kind: str = "min", reach: int = 1) -> DataFrame:
    """Rows strictly below (or above) all neighbours within ``reach``; beyond the ends there are none to beat."""
    w = _window(by, order)
    agg, beaten = (F.min, lambda a, b: a < b) if kind == "min" else (F.max, lambda a, b: a > b)
    left, right = agg(y).over(w.rowsBetween(-reach, -1)), agg(y).over(w.rowsBetween(1, reach))
    rows = df.withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("__l", left).withColumn("__r", right)
    ok = (F.col("__l").isNull() | beaten(F.col(y), F.col("__l"))) & (F.col("__r").isNull() | beaten(F.col(y), F.col("__r")))
    return rows.where(ok).drop("__l", "__r")


def find_peaks(df: DataFrame, y: str, order, by=(), height: float | None = None, threshold: float | None = None) -> DataFrame:
    """Strict interior maxima, at least ``height`` high and ``threshold`` above both neighbours."""
    w = _window(by, order)
    rows = df.withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("__l", F.lag(y).over(w)).withColumn("__r", F.lead(y).over(w))
    ok = (F.col(y) > F.col("__l")) & (F.col(y) > F.col("__r"))
    if height is not None:
        ok &= F.col(y) >= height
    if threshold is not None:
        ok &= F.least(F.col(y) - F.col("__l"), F.col(y) - F.col("__r")) >= threshold
    return rows.where(ok).drop("__l", "__r")


def decimate(df: DataFrame, order, q: int, by=()) -> DataFrame:
    """Every q-th row of each series (filter before with ``convolve`` or ``gaussian_filter``)."""
    return df.withColumn("__i", F.row_number().over(_window(by, order)) - 1).where(F.col("__i") % q == 0).drop("__i")


def haar_dwt(df: DataFrame, y: str, order, by=()) -> DataFrame:
    """(by, pos, approx, detail): one level over pairs; an odd last value pairs with itself."""
    keys = _by(by)
    i = F.row_number().over(_window(by, order)) - 1
    pairs = df.select(*keys, i.alias("__i"), F.col(y).cast("double").alias("__y")).groupBy(*keys, F.floor(F.col("__i") / 2).alias("pos"))
    a = F.sum(F.when(F.col("__i") % 2 == 0, F.col("__y")))
    b = F.coalesce(F.sum(F.when(F.col("__i") % 2 == 1, F.col("__y"))), a)
    return pairs.agg(((a + b) / math.sqrt(2)).alias("approx"), ((a - b) / math.sqrt(2)).alias("detail"))


# Decomposition low-pass filters.
WAVELETS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314469025, 0.836516303737469, 0.22414386804185735, -0.12940952255092145],
    "db3": [0.3326705529509569, 0.8068915093133388, 0.4598775021193313, -0.13501102001039084, -0.08544127388224149, 0.035226291882100656],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}
EXTENSIONS = ("symmetric", "zero", "constant", "periodic", "smooth")


def _extended(df: DataFrame, y: str, order: str, by, pad: int, mode: str) -> DataFrame:
    """(by, __pos, __y): each series with ``pad`` more values at both ends, by the rules of the wavelet transforms.

    symmetric mirrors the left end with the end value (c b a | a b c d) and the right end without it (a b c d | c b a);
    periodic mirrors the left end and goes on from the start at the right; constant repeats the end values, smooth
    goes on in the line of the last two, zero adds zeros. Short series go through their values again.
    """
    if mode not in EXTENSIONS:
        raise ValueError(f"extension is one of {', '.join(EXTENSIONS)}")
    keys = _by(by)
    w = Window.partitionBy(*keys)
    at = w.orderBy(order)
    p, n, v = F.col("__pos"), F.col("__n"), F.col("__y")
    rows = df.select(*keys, (F.row_number().over(at) - 1).alias("__pos"), F.count("*").over(w).alias("__n"), F.col(y).cast("double").alias("__y"), F.lag(y).over(at).alias("__b"), F.lead(y).over(at).alias("__a"))
    more = []
    for i in range(pad):
        k = F.lit(i)
        if mode == "symmetric":
            left = F.when(k < n, k).otherwise(F.greatest(2 * n - 2 - k, F.lit(0)))
            right = F.when(n > 1 + k, n - 2 - k).otherwise(k % n)
        elif mode == "periodic":
            left = right = k % n
        else:
            left, right = F.lit(0), n - 1
        before = {"zero": F.lit(0.0), "smooth": v - F.coalesce(F.col("__a") - v, F.lit(0.0)) * (i + 1)}.get(mode, v)
        after = {"zero": F.lit(0.0), "smooth": v + F.coalesce(v - F.col("__b"), F.lit(0.0)) * (i + 1)}.get(mode, v)
        more += [F.when(p == left, F.struct(F.lit(-1 - i).cast("long").alias("at"), before.alias("y"))), F.when(p == right, F.struct((n + k).cast("long").alias("at"), after.alias("y")))]
    every = F.filter(F.array(F.struct(p.cast("long").alias("at"), v.alias("y")), *more), lambda e: e.isNotNull())
    return rows.select(*keys, F.explode(every).alias("__e")).select(*keys, F.col("__e.at").alias("__pos"), F.col("__e.y").alias("__y"))


def _high(low: list[float]) -> list[float]:
    """The mirror filter: reversed, every second value negated."""
    return [c if k % 2 else -c for k, c in enumerate(low)][::-1]


def dwt(df: DataFrame, y: str, order: str, by=(), wavelet: str = "haar", extension: str = "symmetric") -> DataFrame:
    """(by, pos, approx, detail): one level of a wavelet transform.

    The series is extended by L - 1 values at both ends, correlated with the filters, and every second value kept.
    """
    low = WAVELETS[wavelet]
    n, keys = len(low), _by(by)
    high = _high(low)
    w = Window.partitionBy(*keys).orderBy("__pos")
    rows = _extended(df, y, order, by, n - 1, extension)
    out = rows.withColumn("approx", _weighted(w, low, 0)).withColumn("detail", _weighted(w, high, 0)).withColumn("__i", F.row_number().over(w) - 1)
    return out.where((F.col("__i") % 2 == 0) & F.col("approx").isNotNull()).select(*keys, (F.col("__i") / 2).cast("long").alias("pos"), "approx", "detail")


def _merged(parts: DataFrame, keys: list[str], wavelet: str, extension: str) -> DataFrame:
    """(by, pos, value) from two series (by, part, pos, value) a key, part approx or detail: one sort for both, then a sum."""
    low = WAVELETS[wavelet]
    n = len(low)
    both = [*keys, "part"]
    spread = parts.select(*both, F.explode(F.array(F.struct((F.col("pos") * 2).alias("at"), F.col("value").alias("y")), F.struct((F.col("pos") * 2 + 1).alias("at"), F.lit(0.0).alias("y")))).alias("__s")).select(*both, "__s.at", "__s.y")
    w = Window.partitionBy(*both).orderBy("__pos")
    rows = _extended(spread, "y", "at", both, n - 1, extension)
    value = F.when(F.col("part") == "approx", _weighted(w, low[::-1], 0)).otherwise(_weighted(w, _high(low)[::-1], 0))
    out = rows.select(*keys, (F.col("__pos") + (n - 1)).alias("pos"), value.alias("__v")).where("__v IS NOT NULL")
    return out.groupBy(*keys, "pos").agg(F.sum("__v").alias("value"), F.count("*").alias("__n")).where("__n = 2").drop("__n")


def idwt(df: DataFrame, by=(), wavelet: str = "haar", extension: str = "symmetric") -> DataFrame:
    """(by, pos, value) from rows (by, pos, approx, detail): zeros between the coefficients, both correlated with the reversed filters.

    The result keeps the L - 1 values by which ``dwt`` extends the series: value 0 of the series is at pos L - 1.
    Away from the ends it is the series itself; 2 m + L - 1 values from m coefficients.
    """
    keys = _by(by)
    part = [F.struct(F.lit(name).alias("part"), F.col(name).cast("double").alias("value")) for name in ("approx", "detail")]
    return _merged(df.select(*keys, "pos", F.explode(F.array(*part)).alias("__p")).select(*keys, "pos", "__p.*"), keys, wavelet, extension)


def wavedec(df: DataFrame, y: str, order: str, by=(), wavelet: str = "haar", extension: str = "symmetric", level: int = 1) -> DataFrame:
    """(by, level, part, pos, value): details of levels 1 to ``level`` and the last level's approximation.

    A level is written before the next one reads it, so none is computed twice; each is half as long as the one before.
    """
    if level < 1:
        raise ValueError("level is at least 1")
    keys, out = _by(by), []
    at, value, place = df, y, order
    for step in range(1, level + 1):
        at = settled(dwt(at, value, place, by, wavelet, extension))
        value, place = "approx", "pos"
        parts = ["detail", "approx"] if step == level else ["detail"]
        out += [at.select(*keys, F.lit(step).alias("level"), F.lit(part).alias("part"), "pos", F.col(part).alias("value")) for part in parts]
    return functools.reduce(DataFrame.unionByName, out)


def waverec(coeffs: DataFrame, by=(), wavelet: str = "haar", extension: str = "symmetric", level: int = 1) -> DataFrame:
    """(by, pos, value) from the rows of ``wavedec``, from the last level to the first; the longer of two series is cut to the shorter."""
    keys = _by(by)
    now = coeffs.where((F.col("level") == level) & (F.col("part") == "approx")).select(*keys, "pos", "value")
    for step in range(level, 0, -1):
        detail = coeffs.where((F.col("level") == step) & (F.col("part") == "detail")).select(*keys, F.lit("detail").alias("part"), "pos", "value")
        now = _merged(detail.unionByName(now.withColumn("part", F.lit("approx"))), keys, wavelet, extension)
    return now


# --- spectra -------------------------------------------------------------------------------


def lombscargle(df: DataFrame, y: str, t: str, freqs: list[float], by=()) -> DataFrame:
    """(by, freq, power): least-squares spectrum of uneven samples, by sums alone.

    Frequencies (angular) are a parameter list; each row meets each frequency, sums combine before the shuffle.
    """
    keys = _by(by)
    means = df.groupBy(*keys).agg(F.avg(y).alias("__m"))
    rows = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))  # one row
    at = rows.select(*keys, (F.col(y) - F.col("__m")).alias("v"), F.col(t).cast("double").alias("t"), F.explode(F.array(*map(F.lit, map(float, freqs)))).alias("freq"))
    w = F.col("freq") * F.col("t")
    sums = at.groupBy(*keys, "freq").agg(
        F.sum(F.sin(2 * w)).alias("s2"), F.sum(F.cos(2 * w)).alias("c2"), F.sum(F.col("v") * F.cos(w)).alias("yc"), F.sum(F.col("v") * F.sin(w)).alias("ys"), F.count("*").alias("n")
    )
    tau = F.atan2("s2", "c2") / 2
    # cos and sin about tau follow from the plain sums.
    c, s = F.cos(tau), F.sin(tau)
    yc, ys = F.col("yc") * c + F.col("ys") * s, F.col("ys") * c - F.col("yc") * s
    half = (F.col("c2") * F.cos(2 * tau) + F.col("s2") * F.sin(2 * tau)) / 2
    cc, ss = F.col("n") / 2 + half, F.col("n") / 2 - half
    return sums.select(*keys, "freq", (0.5 * (yc**2 / cc + F.when(F.abs(ss) > 1e-12, ys**2 / ss).otherwise(0.0))).alias("power"))


def segments(df: DataFrame, y: str, order, by=(), size: int = 256, step: int = 128) -> DataFrame:
    """(by, segment, values): overlapping segments of ``size`` values as arrays, whole ones only.

    Each row goes to the segments that hold it; a row of the result is bounded by the segment's size.
    """
    keys = _by(by)
    i = F.row_number().over(_window(by, order)) - 1
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("long")
    last = F.floor(F.col("__i") / step).cast("long")
    rows = df.select(*keys, i.alias("__i"), F.col(y).cast("double").alias("__y")).where("__y IS NOT NULL")
    dealt = rows.withColumn("__f", first).withColumn("__l", last).where("__l >= __f").select(*keys, "__i", "__y", F.explode(F.sequence("__f", "__l")).alias("segment"))
    packed = dealt.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct("__i", "__y"))).alias("v")).where(F.size("v") == size)
    return packed.select(*keys, "segment", F.transform("v", lambda p: p["__y"]).alias("values"))


def _spectra(values: Column, size: int, fs: float, window: str, detrend: bool) -> Column:
    """Arrow helper: the one-sided power density of each segment."""

    @F.pandas_udf("array<double>")
    def psd(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist(), float).reshape(-1, size)
        if detrend:
            m = m - m.mean(axis=1, keepdims=True)
        taper = windows.samples(window, size, periodic=False)
        n = 1 << (size - 1).bit_length()
        power = np.abs(np.fft.rfft(m * taper, n, axis=1)) ** 2 / (fs * (taper**2).sum())
        power[:, 1 : -1 if n % 2 == 0 else None] *= 2
        return pd.Series(list(power))

    return psd(values)


def welch(df: DataFrame, y: str, order, by=(), fs: float = 1.0, nperseg: int = 256, window: str = "hann", detrend: bool = True) -> DataFrame:
    """(by, bin, freq, psd): segments transformed a row each, then averaged by bin with a plain aggregate."""
    keys = _by(by)
    n = 1 << (nperseg - 1).bit_length()
    cut = segments(df, y, order, by, nperseg, nperseg // 2)
    bins = cut.select(*keys, F.posexplode(_spectra(F.col("values"), nperseg, fs, window, detrend)).alias("bin", "p"))
    return bins.groupBy(*keys, "bin").agg(F.avg("p").alias("psd")).select(*keys, F.col("bin").cast("long").alias("bin"), (F.col("bin") * fs / n).alias("freq"), "psd")


def stft(df: DataFrame, y: str, order, by=(), n_fft: int = 256, hop: int | None = None, window: str = "hann") -> DataFrame:
    """(by, frame, bin, re, im) of whole frames; the window is periodic."""
    keys = _by(by)

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def transform(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist(), float).reshape(-1, n_fft) * windows.samples(window, n_fft, periodic=True)
        return pd.Series([[{"re": z.real, "im": z.imag} for z in row] for row in np.fft.rfft(m, axis=1)])

    cut = segments(df, y, order, by, n_fft, hop or n_fft // 4)
    return cut.select(*keys, F.col("segment").alias("frame"), F.posexplode(transform("values")).alias("bin", "z")).select(*keys, "frame", "bin", "z.re", "z.im")


def spectrogram(df: DataFrame, y: str, order, by=(), n_fft: int = 256, hop: int | None = None, window: str = "hann", power: float = 2.0) -> DataFrame:
    z = stft(df, y, order, by, n_fft, hop, window)
    return z.withColumn("power", F.pow(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), power)).drop("re", "im")


def detrend(df: DataFrame, y: str, order, by=(), kind: str = "linear", out: str = "detrended") -> DataFrame:
    """Without the mean or the least-squares line over the positions; moments are aggregated and joined back."""
    keys = _by(by)
    rows = df.withColumn("__i", (F.row_number().over(_window(by, order)) - 1).cast("double"))
    fit = rows.groupBy(*keys).agg(F.avg(y).alias("__m"), F.avg("__i").alias("__c"), F.coalesce(F.regr_slope(y, "__i"), F.lit(0.0)).alias("__b"))
    joined = rows.join(fit, keys) if keys else rows.crossJoin(F.broadcast(fit))  # one row
    line = F.col("__m") + (F.col("__b") * (F.col("__i") - F.col("__c")) if kind == "linear" else 0.0)
    return joined.withColumn(out, F.col(y) - line).drop("__i", "__m", "__c", "__b")


def leading_bins(df: DataFrame, y: str, order, by=(), bins: int = 16, fs: float = 1.0, detrend: bool = True) -> DataFrame:
    """(by, bin, freq, psd): one-sided power density of whole series at their first ``bins`` frequencies only, by plain sums over all rows (``fourier.periodogram`` has all)."""
    keys = _by(by)
    mean = df.groupBy(*keys).agg(F.avg(y).alias("__m"), F.count(y).alias("__n"))
    held = df.where(F.col(y).isNotNull())
    i = (F.row_number().over(_window(by, order)) - 1).cast("double")
    rows = held.select(*keys, i.alias("__i"), F.col(y).cast("double").alias("__y"))
    rows = rows.join(mean, keys) if keys else rows.crossJoin(F.broadcast(mean))  # one row
    angle = 2 * math.pi * F.col("bin") * F.col("__i") / F.col("__n")
    value = F.col("__y") - F.col("__m") if detrend else F.col("__y")
    each = rows.select(*keys, "__n", value.alias("__v"), "__i", F.explode(F.sequence(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col("__n") / 2).cast("int")))).alias("bin"))
    sums = each.groupBy(*keys, "bin").agg(F.sum(F.col("__v") * F.cos(angle)).alias("re"), F.sum(F.col("__v") * F.sin(angle)).alias("im"), F.max("__n").alias("n"))
    sides = F.when((F.col("bin") == 0) | (2 * F.col("bin") == F.col("n")), 1.0).otherwise(2.0)
    return sums.select(*keys, F.col("bin").cast("long").alias("bin"), (F.col("bin") * fs / F.col("n")).alias("freq"), (sides * (F.col("re") ** 2 + F.col("im") ** 2) / (fs * F.col("n"))).alias("psd"))


def csd(df: DataFrame, x: str, y: str, order, by=(), fs: float = 1.0, nperseg: int = 256, window: str = "hann", detrend: bool = True) -> DataFrame:
    """(by, bin, freq, re, im, pxx, pyy): cross density of two columns and the density of each, averaged over half-overlapping segments.

    Rows where either column is null take no part.
    """
    keys = _by(by)
    n = 1 << (nperseg - 1).bit_length()

    @F.pandas_udf("array<struct<re:double,im:double,pxx:double,pyy:double>>")
    def cross(v: pd.Series, w: pd.Series) -> pd.Series:
        taper = windows.samples(window, nperseg, periodic=False)
        a, b = (np.array(c.tolist(), float).reshape(-1, nperseg) for c in (v, w))
        if detrend:
            a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        fa, fb = (np.fft.rfft(c * taper, n, axis=1) for c in (a, b))
        scale = np.full(fa.shape[1], 2.0 / (fs * (taper**2).sum()))
        scale[0] /= 2
        if n % 2 == 0:
            scale[-1] /= 2
        z, pa, pb = np.conj(fa) * fb * scale, np.abs(fa) ** 2 * scale, np.abs(fb) ** 2 * scale
        return pd.Series([[{"re": c.real, "im": c.imag, "pxx": p, "pyy": q} for c, p, q in zip(*r, strict=True)] for r in zip(z, pa, pb, strict=True)])

    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    left, right = (segments(both, c, order, by, nperseg, nperseg // 2) for c in (x, y))
    met = left.join(right.withColumnRenamed("values", "others"), [*keys, "segment"])
    bins = met.select(*keys, F.posexplode(cross("values", "others")).alias("bin", "p"))
    out = bins.groupBy(*keys, "bin").agg(*(F.avg(f"p.{c}").alias(c) for c in ("re", "im", "pxx", "pyy")))
    return out.select(*keys, F.col("bin").cast("long").alias("bin"), (F.col("bin") * fs / n).alias("freq"), "re", "im", "pxx", "pyy")


def coherence(df: DataFrame, x: str, y: str, order, by=(), fs: float = 1.0, nperseg: int = 256, window: str = "hann", detrend: bool = True) -> DataFrame:
    """(by, bin, freq, coherence): the cross density's squared length over the product of both densities; null where a column has no power."""
    z = csd(df, x, y, order, by, fs, nperseg, window, detrend)
    return z.select(*_by(by), "bin", "freq", F.try_divide(F.col("re") ** 2 + F.col("im") ** 2, F.col("pxx") * F.col("pyy")).alias("coherence"))


def istft(df: DataFrame, by=(), n_fft: int = 256, hop: int | None = None, window: str = "hann") -> DataFrame:
    """(by, i, value) from (by, frame, bin, re, im) of stft: frames go back to samples, which add up by position over the squared window.

    Positions that no window weighs have no value.
    """
    keys, step = _by(by), hop or n_fft // 4

    @F.pandas_udf("array<double>")
    def back(re: pd.Series, im: pd.Series) -> pd.Series:
        z = np.array(re.tolist(), float) + 1j * np.array(im.tolist(), float)
        return pd.Series(list(np.fft.irfft(z, n_fft, axis=1) * windows.samples(window, n_fft, periodic=True)))

    weight = F.array(*(F.lit(float(w * w)) for w in windows.samples(window, n_fft, periodic=True)))
    frames = df.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(F.struct("bin", "re", "im"))).alias("z"))
    samples = frames.select(*keys, "frame", F.posexplode(back(F.col("z.re"), F.col("z.im"))).alias("k", "v"))
    at = samples.select(*keys, (F.col("frame") * step + F.col("k")).cast("long").alias("i"), "v", F.get(weight, F.col("k")).alias("w"))
    return at.groupBy(*keys, "i").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).where("w > 1e-10").select(*keys, "i", (F.col("v") / F.col("w")).alias("value"))
