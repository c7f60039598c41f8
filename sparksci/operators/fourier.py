"""Transforms of long series: the four-step FFT by two exchanges, and what rests on it.

A transform of N = N1 * N2 values is N2 transforms down the columns of an N1 x N2 table,
a turn of each value, and N1 transforms along its rows; tasks hold a few columns or rows,
so one series spreads over many tasks and a group holds about the square root of N, or
CHUNK values.  Lengths that are no powers of two go through a chirp and one convolution
of the next power of two.

Series are rows (by, pos, re, im) with pos counting from 0; positions without a row are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparksci.functions import windows
from sparksci.operators.filters import _placed, _same
from sparksci.operators.statistics import _by
from sparksci.sources.tables import stored

#: Values that a group of columns (or rows) holds, about.
CHUNK = 1 << 16
#: Values of results that a task holds at once, about.
PIECE = 1 << 18


def _split(n: int) -> tuple[int, int]:
    """n, a power of two, as rows and columns of about one size."""
    bits = n.bit_length() - 1
    return 1 << bits // 2, 1 << bits - bits // 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for about PIECE values of the result at a time, so that a task holds few of them, however many series a batch brings."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        piece = (np.cumsum(np.minimum(size, np.maximum(CHUNK, np.sqrt(size)))) // PIECE).astype(int)
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(size)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends, and the values of all."""
    return column.offsets.to_numpy(), column.values


def _packed(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts)))


def fft(rows: DataFrame, by=(), inverse: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(by, size, pos, re, im) of rows (by, size, pos, re, im); size, a power of two, is the length of the row's series.

    The inverse divides by the size. Every position of the result has a row. ``sizes`` (by, size), if given, has the
    series of the rows; otherwise the rows are computed once more to find them.
    """
    keys = _by(by)
    kinds = dict(rows.dtypes)
    sign = 1 if inverse else -1
    own = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    columns, chunk = [*keys, "size"], CHUNK

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of columns: transformed, turned, and cut into the groups of rows that the next step takes."""
        for part in _pieces(batches):
            ends, at = _lists(part.column("pos"))
            at, re, im = at.to_numpy(), *(_lists(part.column(c))[1].to_numpy(zero_copy_only=False) for c in ("re", "im"))
            from_row, groups, starts, real, imaginary = [], [], [], [], []
            for k, (n, group) in enumerate(zip(part.column("size").to_pylist(), part.column("group").to_pylist(), strict=True)):
                n1, n2 = _split(n)
                width, height = max(1, chunk // n1), max(1, chunk // n2)
                held = slice(ends[k], ends[k + 1])
                pos, start = at[held], group * width
                m = np.zeros((n1, min(width, n2 - start)), complex)
                np.add.at(m, (pos // n2, pos % n2 - start), re[held] + 1j * im[held])
                m = np.fft.ifft(m, axis=0) * n1 if inverse else np.fft.fft(m, axis=0)
                turn = np.outer(np.arange(n1), np.arange(start, start + m.shape[1])) % n
                m *= np.exp(sign * 2j * np.pi * turn / n)
                for c in range(0, n1, height):
                    from_row.append(k)
                    groups.append(c // height)
                    starts.append(start)
                    real.append(m[c : c + height].real.ravel())
                    imaginary.append(m[c : c + height].imag.ravel())
            held = [part.column(c).take(pa.array(from_row)) for c in columns]
            yield pa.RecordBatch.from_arrays([*held, pa.array(groups, pa.int64()), pa.array(starts, pa.int64()), _packed(real), _packed(imaginary)], [*columns, "group", "start", "re", "im"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows, put together from the column groups and transformed."""
        for part in _pieces(batches):
            ends, starts = _lists(part.column("start"))
            starts = starts.to_numpy()
            inner, re = _lists(_lists(part.column("re"))[1])
            re, im = re.to_numpy(), _lists(_lists(part.column("im"))[1])[1].to_numpy()
            at, out = [], []
            for k, (n, group) in enumerate(zip(part.column("size").to_pylist(), part.column("group").to_pylist(), strict=True)):
                n1, n2 = _split(n)
                height = max(1, chunk // n2)
                first_row = group * height
                held = min(height, n1 - first_row)
                m = np.zeros((held, n2), complex)
                for j in range(ends[k], ends[k + 1]):
                    block = slice(inner[j], inner[j + 1])
                    values = (re[block] + 1j * im[block]).reshape(held, -1)
                    m[:, starts[j] : starts[j] + values.shape[1]] = values
                m = np.fft.ifft(m, axis=1) * n2 / n if inverse else np.fft.fft(m, axis=1)
                at.append((np.arange(first_row, first_row + held)[:, None] + n1 * np.arange(n2)).ravel())
                out.append(m.ravel())
            of = pa.array(np.repeat(np.arange(len(out)), [len(o) for o in out]))
            values = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in columns), pa.array(np.concatenate(at)), pa.array(values.real.copy()), pa.array(values.imag.copy())], [*columns, "pos", "re", "im"])

    # Rows and columns of the table follow from the number of bits of the size.
    bits = F.floor(F.log2(F.col("size").cast("double")) + 0.5).cast("int")
    n1 = F.pow(F.lit(2.0), F.floor(bits / 2)).cast("long")
    n2 = (F.col("size") / n1).cast("long")
    group = F.floor((F.col("pos") % n2) / F.greatest(F.lit(1), F.floor(F.lit(chunk) / n1))).cast("long")
    # Groups without any value must still say that they are zero: one row each.
    groups = F.sequence(F.lit(0).cast("long"), F.floor((n2 - 1) / F.greatest(F.lit(1), F.floor(F.lit(chunk) / n1))).cast("long"))
    every = (rows.select(*columns).distinct() if sizes is None else sizes).select(*columns, F.explode(groups).alias("__g"))
    nothing = every.select(*columns, (F.col("__g") * F.greatest(F.lit(1), F.floor(F.lit(chunk) / n1))).cast("long").alias("pos"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"), "__g")
    dealt = rows.select(*columns, "pos", "re", "im", group.alias("__g")).unionByName(nothing)
    packed = dealt.groupBy(*columns, "__g").agg(F.collect_list(F.struct("pos", "re", "im")).alias("__v"))
    apart = lambda df, *names: df.select(*columns, F.col("__g").alias("group"), *(F.col(f"__v.{n}").alias(n) for n in names))
    turned = apart(packed, "pos", "re", "im").mapInArrow(first, f"{own}size long, group long, start long, re array<double>, im array<double>").withColumnRenamed("group", "__g")
    gathered = turned.groupBy(*columns, "__g").agg(F.collect_list(F.struct("start", "re", "im")).alias("__v"))
    return apart(gathered, "start", "re", "im").mapInArrow(second, f"{own}size long, pos long, re double, im double")


def power_of_two(n):
    """The least power of two that is not below a column n of at least 1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(n > 1, F.length(F.bin((n - 1).cast("long")))).otherwise(0))


def dft(rows: DataFrame, by=(), inverse: bool = False, lengths: DataFrame | None = None) -> DataFrame:
    """(by, n, pos, re, im) of rows (by, n, pos, re, im): a transform of any length n; the inverse divides by n.

    ``lengths`` (by, n), if given, has the series of the rows; otherwise the rows are computed once more to find them.

    X(k) = w(k) sum x(m) w(m) conj(w(k - m)) with w(m) = exp(-+ i pi m m / n): a convolution, by three power-of-two transforms.
    """
    keys = _by(by)
    sign = 1.0 if inverse else -1.0
    angle = lambda m, n: F.lit(sign * math.pi) * ((m * m) % (2 * n)) / n

    def turned(re, im, a, conjugate=False):
        s = -F.sin(a) if conjugate else F.sin(a)
        return (re * F.cos(a) - im * s).alias("re"), (re * s + im * F.cos(a)).alias("im")

    size = power_of_two(2 * F.col("n") - 1)
    sizes = stored((rows.select(*keys, "n").distinct() if lengths is None else lengths.select(*keys, "n")).withColumn("size", size))
    a = rows.select(*keys, size.alias("size"), "pos", *turned(F.col("re"), F.col("im"), angle(F.col("pos"), F.col("n"))))
    # The chirp, on both sides of 0; one for each length, shared by the series of that length.
    shared = sizes.select("n", "size").distinct()
    m = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    chirp = shared.select("n", "size", m.alias("m"))
    both = F.explode(F.when(F.col("m") > 0, F.array(F.col("m"), F.col("size") - F.col("m"))).otherwise(F.array("m")))
    b = chirp.select("n", "size", both.alias("pos"), F.cos(angle(F.col("m"), F.col("n"))).alias("re"), (-F.sin(angle(F.col("m"), F.col("n")))).alias("im"))
    fa = fft(a, keys, sizes=sizes)
    fb = fft(b, ["n"], sizes=shared).select("n", F.col("size").alias("s2"), F.col("pos").alias("p2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    fa = _same(keys, fa, sizes.select(*keys, "n"), F.lit(True))
    met = fa.join(fb.withColumnRenamed("n", "n2"), (F.col("n") == F.col("n2")) & (F.col("size") == F.col("s2")) & (F.col("pos") == F.col("p2")))
    product = met.select(*keys, "size", "pos", (F.col("re") * F.col("re2") - F.col("im") * F.col("im2")).alias("re"), (F.col("re") * F.col("im2") + F.col("im") * F.col("re2")).alias("im"))
    c = _same(keys, fft(product, keys, True, sizes), sizes.select(*keys, "n"), F.lit(True)).where(F.col("pos") < F.col("n"))
    scale = 1 / F.col("n") if inverse else F.lit(1.0)
    return c.select(*keys, "n", "pos", *turned(F.col("re") * scale, F.col("im") * scale, angle(F.col("pos"), F.col("n"))))


def _series(df: DataFrame, x: str, order: str, by) -> tuple[DataFrame, DataFrame, list[str]]:
    """Written rows (by, pos, t, x) and (by, n)."""
    rows, keys = _placed(df, x, order, by)
    rows = stored(rows)
    return rows, stored(rows.groupBy(*keys).agg(F.count("*").alias("n"))), keys


def _with(rows: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    return _same(keys, rows, sizes, F.lit(True))


def hilbert(df: DataFrame, x: str, order: str, by=()) -> DataFrame:
    """(by, order, re, im, envelope, phase, frequency): the analytic signal, its length, angle, and the angle's step.

    Positive frequencies count twice, negative ones not at all; the step is unwrapped to -pi .. pi, 0 at the first sample.
    """
    rows, sizes, keys = _series(df, x, order, by)
    spectrum = dft(_with(rows, sizes, keys).select(*keys, "n", "pos", F.col("x").alias("re"), F.lit(0.0).alias("im")), keys, lengths=sizes)
    half = F.floor(F.col("n") / 2)
    weight = F.when(F.col("pos") == 0, 1.0).when(F.col("pos") < half, 2.0).when(F.col("pos") > half, 0.0).when(F.col("n") % 2 == 0, 1.0).otherwise(2.0)
    back = dft(spectrum.select(*keys, "n", "pos", (F.col("re") * weight).alias("re"), (F.col("im") * weight).alias("im")), keys, True, sizes)
    out = back.withColumn("phase", F.atan2("im", "re"))
    before = out.select(*keys, (F.col("pos") + 1).alias("__p"), F.col("phase").alias("__before"))
    out = _same(keys, out, before, F.col("pos") == F.col("__p"))
    step = F.coalesce(F.col("phase") - F.col("__before"), F.lit(0.0))
    step = F.when(step > math.pi, step - 2 * math.pi).when(step < -math.pi, step + 2 * math.pi).otherwise(step)
    named = rows.select(*keys, F.col("pos").alias("__at"), F.col("t").alias(order))
    out = out.select(*keys, "pos", "re", "im", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("envelope"), "phase", step.alias("frequency"))
    return _same(keys, out, named, F.col("pos") == F.col("__at")).select(*keys, order, "re", "im", "envelope", "phase", "frequency")


def resample(df: DataFrame, x: str, order: str, num: int, den: int, by=()) -> DataFrame:
    """(by, pos, value): the series at num / den times its rate, ceil(n * num / den) values, by its spectrum.

    Frequencies that both lengths have are kept, the middle one of an even length once; the result is scaled to the
    same height.
    """
    if num < 1 or den < 1:
        raise ValueError("factors are positive")
    rows, sizes, keys = _series(df, x, order, by)
    if num == den:
        return rows.select(*keys, "pos", F.col("x").alias("value"))
    spectrum = dft(_with(rows, sizes, keys).select(*keys, "n", "pos", F.col("x").alias("re"), F.lit(0.0).alias("im")), keys, lengths=sizes)
    n, k = F.col("n"), F.col("pos")
    out = F.ceil(n * num / den).cast("long")
    positive = F.floor(F.least(n, out) / 2)
    negative = F.floor((F.least(n, out) - 1) / 2)
    to = F.when(k <= positive, k).when(n - k <= negative, out - (n - k))
    kept = spectrum.select(*keys, out.alias("m"), to.alias("at"), (F.col("re") * out / n).alias("re"), (F.col("im") * out / n).alias("im")).where("at IS NOT NULL AND at < m")
    back = dft(kept.select(*keys, F.col("m").alias("n"), F.col("at").alias("pos"), "re", "im"), keys, True, sizes.select(*keys, out.alias("n")))
    return back.select(*keys, "pos", F.col("re").alias("value"))


SCALINGS = ("density", "spectrum")


def periodogram(df: DataFrame, x: str, order: str, by=(), fs: float = 1.0, window: str = "hann", nfft: int | None = None, detrend: str = "constant", scaling: str = "density", onesided: bool = True) -> DataFrame:
    """(by, bin, freq, psd): the squared spectrum of whole series at all nfft / 2 + 1 frequencies.

    nfft is the least power of two that is not below the series' length (or the length asked for, if longer). The
    series is freed from its mean (constant) or line (linear) first and weighed by the window; density divides by
    fs and the window's squares, spectrum by the squares alone; one-sided values but the first and last count twice.
    A window without weight (hann of two values) gives null.
    """
    if scaling not in SCALINGS or detrend not in ("none", "constant", "linear"):
        raise ValueError("scaling is density or spectrum, detrend none, constant or linear")
    rows, sizes, keys = _series(df, x, order, by)
    fit = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("__m"), F.avg(F.col("pos").cast("double")).alias("__c"), F.coalesce(F.regr_slope("x", F.col("pos").cast("double")), F.lit(0.0)).alias("__b"))
    held = _with(rows, fit, keys)
    if detrend == "none":
        value = F.col("x")
    else:
        value = F.col("x") - F.col("__m") - (F.col("__b") * (F.col("pos") - F.col("__c")) if detrend == "linear" else 0.0)
    weight = windows.weight(window, F.col("pos").cast("double"), F.col("n"))
    held = stored(held.select(*keys, "n", "pos", (value * weight).alias("re"), (weight * weight).alias("__w")))
    squares = held.groupBy(*keys).agg(F.sum("__w").alias("__w"))
    size = power_of_two(F.greatest(F.col("n"), F.lit(nfft or 1)))
    spectrum = fft(held.select(*keys, size.cast("long").alias("size"), "pos", "re", F.lit(0.0).alias("im")), keys).where(F.col("pos") <= F.floor(F.col("size") / 2))
    half = F.floor(F.col("size") / 2)
    sides = F.when((F.col("pos") == 0) | (F.col("pos") == half) | F.lit(not onesided) | (half < 2), 1.0).otherwise(2.0)
    scale = F.try_divide(F.lit(1.0), F.lit(fs if scaling == "density" else 1.0) * F.col("__w"))
    done = _with(spectrum, squares, keys)
    return done.select(*keys, F.col("pos").alias("bin"), (F.col("pos") * fs / F.col("size")).alias("freq"), ((F.col("re") ** 2 + F.col("im") ** 2) * scale * sides).alias("psd"))
