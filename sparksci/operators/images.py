"""Linear image filters, distance transforms and grid equations on images in long form (img, y, x, v)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators.morphology import binarised, label
from sparksci.operators.series import gaussian_kernel
from sparksci.sources.tables import settled

LINES = {"x": "y", "y": "x"}


def _at(w, n: Column, i: Column, k: int) -> Column:
    """The value k places on; beyond an end the image is reflected without its end value."""
    if k == 0:
        return F.col("v")
    ahead = F.lead("v", k).over(w) if k > 0 else F.lag("v", -k).over(w)
    # A reflected place lies on the other side at the mirrored distance, one offset for each place near the end.
    back = F.lit(None).cast("double")
    for d in range(abs(k)):
        other = 2 * d - k  # place d from the end: it reads the value 2 d - k away
        here = (n - 1 - i == d) if k > 0 else (i == d)
        step = other if k > 0 else -(2 * d + k)
        value = F.col("v") if step == 0 else (F.lead("v", step).over(w) if step > 0 else F.lag("v", -step).over(w))
        back = F.when(here, value).otherwise(back)
    return F.coalesce(ahead, back)


def correlate_axis(df: DataFrame, kernel: list[float], axis: str) -> DataFrame:
    """Correlation with a short odd kernel along one axis, ends reflected; images are at least as wide as the kernel."""
    w = Window.partitionBy("img", LINES[axis]).orderBy(axis)
    n, i, h = F.count("*").over(Window.partitionBy("img", LINES[axis])), F.row_number().over(w) - 1, len(kernel) // 2
    rows = df.withColumn("__n", n).withColumn("__i", i)
    terms = [_at(w, F.col("__n"), F.col("__i"), k - h) * c for k, c in enumerate(kernel) if c]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return rows.withColumn("v", total).select("img", "y", "x", "v")


def _both(a: DataFrame, b: DataFrame, value) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "__b"), ["img", "y", "x"]).select("img", "y", "x", value(F.col("v"), F.col("__b")).alias("v"))


def sobel(df: DataFrame, axis: str = "x") -> DataFrame:
    return correlate_axis(correlate_axis(df, [-1.0, 0.0, 1.0], axis), [1.0, 2.0, 1.0], LINES[axis])


def prewitt(df: DataFrame, axis: str = "x") -> DataFrame:
    return correlate_axis(correlate_axis(df, [-1.0, 0.0, 1.0], axis), [1.0, 1.0, 1.0], LINES[axis])


def laplace(df: DataFrame) -> DataFrame:
    second = [1.0, -2.0, 1.0]
    return _both(correlate_axis(df, second, "x"), correlate_axis(df, second, "y"), lambda a, b: a + b)


def gaussian(df: DataFrame, sigma: float = 1.0, truncate: float = 4.0) -> DataFrame:
    k = gaussian_kernel(sigma, 0, truncate)
    return correlate_axis(correlate_axis(df, k, "x"), k, "y")


def gaussian_laplace(df: DataFrame, sigma: float = 1.0) -> DataFrame:
    return laplace(gaussian(df, sigma))


def gaussian_gradient_magnitude(df: DataFrame, sigma: float = 1.0) -> DataFrame:
    smooth, slope = gaussian_kernel(sigma), gaussian_kernel(sigma, 1)
    along = lambda a: correlate_axis(correlate_axis(df, slope, a), smooth, LINES[a])
    return _both(along("x"), along("y"), lambda a, b: F.sqrt(a * a + b * b))


def distance_transform(df: DataFrame, metric: str = "euclidean") -> DataFrame:
    """Distance of each zero pixel to the nearest nonzero one; null in an image without any.

    First along columns by two window frames, then each row's pixels look along their own row only.
    """
    w = Window.partitionBy("img", "x").orderBy("y")
    own = F.when(F.col("v") != 0, F.col("y"))
    up = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("img", "x").orderBy(F.desc("y"))
    down = F.last(own, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    first = df.select("img", "y", "x", F.least(F.abs(F.col("y") - up), F.abs(F.col("y") - down)).cast("double").alias("d"))
    row = first.where("d IS NOT NULL").select("img", "y", F.col("x").alias("x2"), F.col("d").alias("d2"))
    step = F.abs(F.col("x") - F.col("x2")).cast("double")
    if metric == "euclidean":
        value = F.sqrt(F.min(step * step + F.col("d2") * F.col("d2")))
    elif metric == "cityblock":
        value = F.min(step + F.col("d2"))
    elif metric == "chessboard":
        value = F.min(F.greatest(step, F.col("d2")))
    else:
        raise ValueError("metric is euclidean, cityblock or chessboard")
    return first.join(row, ["img", "y"], "left").groupBy("img", "y", "x").agg(value.alias("v"))


def binary_fill_holes(df: DataFrame) -> DataFrame:
    """Zeros that no path of zeros joins to the border become 1."""
    ones = binarised(df)
    around = label(ones.withColumn("v", 1.0 - F.col("v")))
    w = Window.partitionBy("img")
    edge = (F.col("y") == F.min("y").over(w)) | (F.col("y") == F.max("y").over(w)) | (F.col("x") == F.min("x").over(w)) | (F.col("x") == F.max("x").over(w))
    open_ = around.withColumn("__e", edge).where("label > 0 AND __e").select("img", "label").distinct().withColumn("__open", F.lit(True))
    return around.join(open_, ["img", "label"], "left").select("img", "y", "x", F.when((F.col("label") > 0) & F.col("__open").isNotNull(), 0.0).otherwise(1.0).alias("v"))


def _neighbours(df: DataFrame) -> Column:
    a, b = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    return F.lag("v").over(a) + F.lead("v").over(a) + F.lag("v").over(b) + F.lead("v").over(b)


def heat(df: DataFrame, rate: float, steps: int) -> DataFrame:
    """Explicit steps of the heat equation, border values held; rate = diffusivity dt / h**2, at most 1/4."""
    if not 0 < rate <= 0.25:
        raise ValueError("the explicit step is stable for 0 < rate <= 1/4 only")
    out = df
    for k in range(steps):
        out = out.withColumn("v", F.coalesce(F.col("v") + rate * (_neighbours(out) - 4 * F.col("v")), F.col("v")))
        if k % 8 == 7:
            out = settled(out)
    return out


def poisson(df: DataFrame, source: str, h: float, tol: float = 1e-8, max_iter: int = 10_000, check_every: int = 8) -> tuple[DataFrame, int]:
    """Solve -laplace(v) = source with v held on the border, by Jacobi iterations: (solution, iterations)."""
    out, done = settled(df), 0
    while done < max_iter:
        before = out
        for _ in range(check_every):
            out = out.withColumn("v", F.coalesce((_neighbours(out) + h * h * F.col(source)) / 4, F.col("v")))
        out, done = settled(out), done + check_every
        moved = out.join(before.withColumnRenamed("v", "__was").select("img", "y", "x", "__was"), ["img", "y", "x"]).agg(F.max(F.abs(F.col("v") - F.col("__was")))).first()[0]
        if moved is None or moved < tol:
            break
    return out, done


def map_coordinates(df: DataFrame, queries: DataFrame, order: str = "linear") -> DataFrame:
    """queries (img, qid, yq, xq) with the value there, between pixels by bilinear weights; outside, the border goes on.

    Every query looks up its four corner pixels by an equi-join; no query meets other pixels.
    """
    ends = df.groupBy("img").agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    q = queries.join(ends, "img")
    y, x = (F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.col(m)) for c, m in (("yq", "__h"), ("xq", "__w")))
    if order == "nearest":
        corners = F.array(F.struct(F.round(y).cast("int").alias("y"), F.round(x).cast("int").alias("x"), F.lit(1.0).alias("w")))
    elif order == "linear":
        y0, x0 = F.floor(y), F.floor(x)
        fy, fx = y - y0, x - x0
        one = lambda dy, dx: F.struct((y0 + dy).cast("int").alias("y"), (x0 + dx).cast("int").alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
        corners = F.filter(F.array(one(0, 0), one(0, 1), one(1, 0), one(1, 1)), lambda c: c["w"] > 0)
    else:
        raise ValueError("order is linear or nearest")
    asked = q.select("img", "qid", F.explode(corners).alias("c")).select("img", "qid", "c.y", "c.x", "c.w")
    return asked.join(df, ["img", "y", "x"]).groupBy("img", "qid").agg(F.sum(F.col("w") * F.col("v")).alias("value"))


def _mapped(df: DataFrame, shape: Callable, source: Callable, order: str) -> DataFrame:
    """Images of shape(h, w) whose pixel (y, x) takes the old value at source(y, x, h, w); h, w are the old shape.

    An image's lines are dealt to tasks before their pixels are made.
    """
    h, w = F.col("__h"), F.col("__w")
    ends = df.groupBy("img").agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    upto = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)))
    rows, columns = shape(h, w)
    lines = ends.select("img", "__h", "__w", upto(rows).alias("y")).repartition("img", "y")
    yq, xq = source(F.col("y"), F.col("x"), h, w)
    asked = lines.select("*", upto(columns).alias("x")).select("img", F.struct("y", "x").alias("qid"), yq.alias("yq"), xq.alias("xq"))
    return map_coordinates(df, asked, order).select("img", "qid.y", "qid.x", F.col("value").alias("v"))


def affine_transform(df: DataFrame, matrix: list[list[float]], offset: tuple[float, float] = (0.0, 0.0), shape: tuple[int, int] | None = None, order: str = "linear") -> DataFrame:
    """Pixel p of the new image takes the value at matrix * p + offset; the old image's shape unless one is given."""
    (a, b), (c, d) = matrix
    size = (lambda h, w: (h, w)) if shape is None else (lambda h, w: (F.lit(shape[0]), F.lit(shape[1])))
    return _mapped(df, size, lambda y, x, h, w: (y * float(a) + x * float(b) + float(offset[0]), y * float(c) + x * float(d) + float(offset[1])), order)


def zoom(df: DataFrame, factors: tuple[float, float], order: str = "linear") -> DataFrame:
    """Scaled about the first pixel; the new shape is the old one times the factors, rounded."""
    fy, fx = map(float, factors)
    if fy <= 0 or fx <= 0:
        raise ValueError("the factors are positive")
    return _mapped(df, lambda h, w: (F.round(h * fy), F.round(w * fx)), lambda y, x, h, w: (y / fy, x / fx), order)


def shift(df: DataFrame, by: tuple[float, float], order: str = "linear") -> DataFrame:
    """Moved by (dy, dx); what comes in repeats the border."""
    return _mapped(df, lambda h, w: (h, w), lambda y, x, h, w: (y - float(by[0]), x - float(by[1])), order)


def rotate(df: DataFrame, angle: float, reshape: bool = False, order: str = "linear") -> DataFrame:
    """Turned about the middle by ``angle`` degrees, counter-clockwise; with ``reshape`` the new image holds all of the old one."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    # A length that is whole but for rounding stays so.
    size = (lambda h, w: (F.ceil(h * abs(c) + w * abs(s) - 1e-9), F.ceil(h * abs(s) + w * abs(c) - 1e-9))) if reshape else (lambda h, w: (h, w))

    def source(y: Column, x: Column, h: Column, w: Column) -> tuple[Column, Column]:
        new_h, new_w = size(h, w)
        dy, dx = y - (new_h - 1) / 2, x - (new_w - 1) / 2
        return (h - 1) / 2 + dy * c + dx * s, (w - 1) / 2 - dy * s + dx * c

    return _mapped(df, size, source, order)


def _sent(df: DataFrame, steps: list[tuple[int, int, float]]) -> DataFrame:
    """(img, y, x, w, v): every pixel's value at each (dy, dx) from it, with that step's weight, where a pixel is."""
    to = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(float(w)).alias("w")) for a, b, w in steps))).alias("s")
    moved = df.select("img", "y", "x", "v", to).select("img", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("s.w").alias("w"), "v")
    return df.select("img", "y", "x").join(moved, ["img", "y", "x"])


def convolve2d(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Convolution with a short kernel, of the image's own size; beyond the image all is 0. Values travel to the pixels that they reach and add up there."""
    h, w = (len(kernel) - 1) // 2, (len(kernel[0]) - 1) // 2
    steps = [(i - h, j - w, c) for i, row in enumerate(kernel) for j, c in enumerate(row)]
    return _sent(df, steps).groupBy("img", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def correlate2d(df: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Convolution with the kernel turned by half a circle."""
    return convolve2d(df, [row[::-1] for row in kernel[::-1]])


def _square(size: int) -> list[tuple[int, int, float]]:
    if size < 1 or size % 2 == 0:
        raise ValueError("the window size must be odd")
    h = size // 2
    return [(a, b, 1.0) for a in range(-h, h + 1) for b in range(-h, h + 1)]


def medfilt2d(df: DataFrame, size: int = 3) -> DataFrame:
    """Median of the square around each pixel; the square shrinks at the borders, and of an even number of values the upper one of the middle two is taken."""
    held = _sent(df, _square(size)).groupBy("img", "y", "x").agg(F.sort_array(F.collect_list("v")).alias("near"))
    return held.select("img", "y", "x", F.get("near", F.floor(F.size("near") / 2).cast("int")).alias("v"))


def wiener2d(df: DataFrame, size: int = 3, noise: float | None = None) -> DataFrame:
    """Local mean plus the share of the deviation above the noise, by default the image's least local variance (at least 1e-10); the square shrinks at the borders."""
    local = _sent(df, _square(size)).groupBy("img", "y", "x").agg(F.avg("v").alias("m"), F.var_pop("v").alias("var"))
    rows = df.join(local, ["img", "y", "x"])
    if noise is None:
        rows = rows.join(rows.groupBy("img").agg(F.greatest(F.min("var"), F.lit(1e-10)).alias("noise")), "img")
    else:
        rows = rows.withColumn("noise", F.lit(float(noise)))
    share = F.when(F.col("var") > F.col("noise"), (F.col("var") - F.col("noise")) / F.col("var")).otherwise(0.0)
    return rows.select("img", "y", "x", (F.col("m") + share * (F.col("v") - F.col("m"))).alias("v"))
