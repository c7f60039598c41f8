"""Descriptive statistics, hypothesis tests and regression over any number of groups.

Every operator takes ``by``, the grouping columns (none: one group), aggregates with
map-side combining, and applies special functions to the aggregated rows only.  Null
values are left out; a statistic below its least number of values is null.  Operators
that rank deal the rows to tasks by ranges of (group, value, tie), so that one group or
one value that holds most of a table is spread over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.functions import special
from sparksci.sources.tables import settled


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _grouped(df: DataFrame, by):
    return df.groupBy(*_by(by))


def describe(df: DataFrame, x: str, by=()) -> DataFrame:
    """Count, extremes, mean, sample variance and deviation, population skewness and excess kurtosis.

    Skewness is 0 for fewer than three values, kurtosis for fewer than four, and both without variance.
    """
    n = F.count(x)
    return _grouped(df, by).agg(
        n.alias("nobs"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("std"),
        F.when((n > 2) & (F.var_pop(x) > 0), F.skewness(x)).otherwise(0.0).alias("skewness"),
        F.when((n > 3) & (F.var_pop(x) > 0), F.kurtosis(x)).otherwise(0.0).alias("kurtosis"),
    )


def percentile(df: DataFrame, x: str, p: float, by=()) -> DataFrame:
    """Exact percentile (0 to 100), interpolated."""
    if not 0 <= p <= 100:
        raise ValueError("a percentile lies between 0 and 100")
    return _grouped(df, by).agg(F.percentile(x, F.lit(p / 100)).alias("percentile"))


def median(df: DataFrame, x: str, by=()) -> DataFrame:
    return _grouped(df, by).agg(F.percentile(x, F.lit(0.5)).alias("median"))


def iqr(df: DataFrame, x: str, by=()) -> DataFrame:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    return _grouped(df, by).agg((q[1] - q[0]).alias("iqr"))


def skewness(df: DataFrame, x: str, by=()) -> DataFrame:
    return _grouped(df, by).agg(F.when(F.count(x) >= 3, F.when(F.var_pop(x) > 0, F.skewness(x)).otherwise(0.0)).alias("skewness"))


def kurtosis(df: DataFrame, x: str, by=()) -> DataFrame:
    return _grouped(df, by).agg(F.when(F.count(x) >= 4, F.when(F.var_pop(x) > 0, F.kurtosis(x)).otherwise(0.0)).alias("kurtosis"))


def sem(df: DataFrame, x: str, by=()) -> DataFrame:
    """Standard error of the mean."""
    return _grouped(df, by).agg((F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"))


def zscore(df: DataFrame, x: str, by=(), out: str = "zscore") -> DataFrame:
    """df with standardised x. The groups' moments are aggregated and joined back, so no group is gathered."""
    keys = _by(by)
    moments = _grouped(df, by).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
    joined = df.join(moments, keys) if keys else df.crossJoin(F.broadcast(moments))  # one row
    return joined.withColumn(out, F.when(F.col("__std") == 0, 0.0).otherwise((F.col(x) - F.col("__mean")) / F.col("__std"))).drop("__mean", "__std")


def _with_t(df: DataFrame) -> DataFrame:
    return df.withColumn("p_value", special.t_p_value(F.col("statistic"), F.col("df")))


def ttest_1samp(df: DataFrame, x: str, popmean: float, by=()) -> DataFrame:
    n = F.count(x)
    out = _grouped(df, by).agg(F.when(n >= 2, F.try_divide(F.avg(x) - popmean, F.stddev_samp(x) / F.sqrt(n))).alias("statistic"), (n - 1).alias("df"))
    return _with_t(out)


def ttest_ind(df: DataFrame, x: str, is_a: Column, by=()) -> DataFrame:
    """Welch's test between the rows where ``is_a`` holds and the others."""
    rows = df.where(is_a.isNotNull()).select(*_by(by), F.when(is_a, F.col(x)).alias("__a"), F.when(~is_a, F.col(x)).alias("__b"))
    out = _grouped(rows, by).agg(*(f(c).alias(f"{k}{c[-1]}") for c in ("__a", "__b") for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    a, b = F.try_divide("va", "na"), F.try_divide("vb", "nb")
    df_ = F.try_divide((a + b) ** 2, F.try_divide(a**2, F.col("na") - 1) + F.try_divide(b**2, F.col("nb") - 1))
    enough = (F.col("na") >= 2) & (F.col("nb") >= 2)
    return _with_t(out.select(*_by(by), F.when(enough, F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(a + b))).alias("statistic"), F.when(enough, df_).alias("df")))


def ttest_rel(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Paired test: the difference of two columns against zero."""
    return ttest_1samp(df.withColumn("__d", F.col(x) - F.col(y)), "__d", 0.0, by)


def pearsonr(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = _grouped(both, by).agg(F.count("*").alias("n"), F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias("r"))
    out = out.withColumn("statistic", F.when(F.col("n") >= 3, F.col("r"))).withColumn("df", F.col("n") - 2)
    t = F.when(F.abs("r") < 1, F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") ** 2))).otherwise(float("inf"))
    return out.withColumn("p_value", F.when(F.col("n") >= 3, special.t_p_value(t, F.col("df")))).drop("r", "n")


def _beside(rows: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the row that ``one`` holds for their keys; null keys are equal. Without keys ``one`` is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(one))
    named = one.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(keys)})
    return rows.join(named, reduce(and_, (F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)))).drop(*(f"__key{i}" for i in range(len(keys))))


def ranks(df: DataFrame, x: str, by=(), tie=(), out: str = "rank", average: bool = False) -> DataFrame:
    """Ordinal ranks from 1 (ties by the columns ``tie``), or average ranks of ties on request; null values rank first.

    Rows are sorted in ranges and written once, numbered within their range; a range's first rank in a
    group is the number of the group's rows in the ranges before it, a table of one row a range and group.
    """
    keys = _by(by)
    order = [*keys, x, *_by(tie)]
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__range", F.shiftright("__at", 33))  # the partition, in the upper bits of the id
    parts = placed.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__held"))
    before = F.coalesce(F.sum("__held").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*keys, "__range", (before + 1 - F.col("__first")).alias("__start"))
    ranked = _beside(placed, starts, [*keys, "__range"]).withColumn(out, F.col("__at") + F.col("__start")).drop("__at", "__range", "__start")
    if not average:
        return ranked
    shared = ranked.groupBy(*keys, x).agg(((F.min(out) + F.max(out)) / 2).alias("__mean"))
    return _beside(ranked.drop(out), shared, [*keys, x]).withColumnRenamed("__mean", out)


def spearmanr(df: DataFrame, x: str, y: str, by=(), tie=(), average_ties: bool = False) -> DataFrame:
    """Pearson correlation of ranks; ties rank in order of ``tie`` unless averaged."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*_by(by), x, y, *_by(tie)]))
    ranked = ranks(ranks(both, x, by, tie, "__rx", average_ties), y, by, tie, "__ry", average_ties)
    return pearsonr(ranked, "__rx", "__ry", by)


def _anova(groups: DataFrame, by) -> DataFrame:
    """F of rows (by, n, mean, var_pop), one for each sample."""
    keys = _by(by)
    n, k = F.sum("n"), F.count("*")
    # Between-sample squares about the grand mean, from sums that stay small: two levels of aggregation.
    grand = groups.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("__grand"))
    joined = groups.join(grand, keys) if keys else groups.crossJoin(F.broadcast(grand))  # one row
    out = joined.groupBy(*keys).agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("__grand")) ** 2).alias("ssb"), F.sum(F.col("n") * F.col("var_pop")).alias("ssw"), (k - 1).alias("df1"), (n - k).alias("df2")
    )
    msw = F.try_divide("ssw", "df2")
    f = F.when(F.col("df1") >= 1, F.when(msw > 0, F.try_divide(F.try_divide("ssb", "df1"), msw)).otherwise(float("inf")))
    return out.select(*keys, f.alias("statistic"), "df1", "df2").withColumn("p_value", special.f_p_value(F.col("statistic"), F.col("df1"), F.col("df2")))


def f_oneway(df: DataFrame, x: str, sample: str, by=()) -> DataFrame:
    """One-way analysis of variance over the values of ``sample``."""
    return _anova(df.where(F.col(x).isNotNull()).groupBy(*_by(by), sample).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop")), by)


def kruskal(df: DataFrame, x: str, sample: str, by=(), tie=()) -> DataFrame:
    keys = _by(by)
    rows = df.where(F.col(x).isNotNull()).select(*dict.fromkeys([*keys, x, sample, *_by(tie)]))
    ranked = ranks(rows, x, by, tie, "__r")
    parts = ranked.groupBy(*keys, sample).agg(F.count("*").alias("n"), F.sum("__r").cast("double").alias("r"))
    n = F.sum("n")
    out = parts.groupBy(*keys).agg((12.0 / (n * (n + 1)) * F.sum(F.col("r") ** 2 / F.col("n")) - 3 * (n + 1)).alias("statistic"), (F.count("*") - 1).alias("df"))
    return out.withColumn("p_value", special.chi2_p_value(F.col("statistic"), F.col("df")))


def friedmanchisquare(df: DataFrame, x: str, treatment: str, subject: str, by=()) -> DataFrame:
    """Treatments ranked within each subject; subjects are the windows, so no task sees more than one's rows."""
    keys = _by(by)
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, subject).orderBy(x, treatment)))
    sums = ranked.groupBy(*keys, treatment).agg(F.sum("__r").cast("double").alias("r"), F.count("*").alias("n"))
    k, n = F.count("*"), F.max("n")
    out = sums.groupBy(*keys).agg(F.when(k >= 3, 12.0 / (n * k * (k + 1)) * F.sum(F.col("r") ** 2) - 3 * n * (k + 1)).alias("statistic"), (k - 1).alias("df"))
    return out.withColumn("p_value", special.chi2_p_value(F.col("statistic"), F.col("df")))


def shapiro(df: DataFrame, x: str, by=(), tie=()) -> DataFrame:
    """W from Blom's normal scores scaled to unit length, with a normal approximation for its p-value."""
    keys = _by(by)
    scored = _order_statistics(df, x, by, tie).withColumn("__m", special.normal_quantile((F.col("__i") - 0.375) / (F.col("__n") + 0.25)))
    n = F.count("*")
    out = scored.groupBy(*keys).agg(n.alias("n"), F.sum(F.col("__m") * F.col(x)).alias("mx"), F.sum(F.col("__m") ** 2).alias("mm"), (F.var_pop(x) * n).alias("ss"))
    stat = F.when(F.col("n") >= 3, F.when(F.col("ss") > 0, F.least(F.lit(1.0), F.try_divide(F.try_divide(F.col("mx") ** 2, F.col("mm")), F.col("ss")))).otherwise(1.0))
    # Fixed values of the normal approximation of ln(1 - W).
    mu, sigma = -1.2725 + 1.0521 * F.log("n"), F.exp(1.0308 - 0.26758 * F.log("n"))
    out = out.withColumn("statistic", stat)
    z = (F.log(F.greatest(1 - F.col("statistic"), F.lit(1e-300))) - mu) / sigma
    upper = F.when(z > 0, special.normal_p_value(z) / 2).otherwise(1 - special.normal_p_value(z) / 2)
    return out.select(*keys, "statistic", upper.alias("p_value"))


def normaltest(df: DataFrame, x: str, by=()) -> DataFrame:
    """Omnibus test: squared z of skewness plus squared z of kurtosis; 20 values at least."""
    out = _grouped(df, by).agg(F.count(x).cast("double").alias("n"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.when(F.col("n") >= 20, F.col("n"))
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n**2 + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    scaled = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(scaled + F.sqrt(scaled**2 + 1)) / F.sqrt(0.5 * F.log(w2))
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    z2 = (F.col("g2") - mean) / F.sqrt(var)
    out = out.withColumn("statistic", z1**2 + z2**2)
    return out.select(*_by(by), "statistic").withColumn("p_value", special.chi2_p_value(F.col("statistic"), F.lit(2)))


def levene(df: DataFrame, x: str, sample: str, center: str = "median", by=(), tie=()) -> DataFrame:
    """Analysis of variance of the absolute deviations from each sample's mean, median or 10 % trimmed mean."""
    keys = [*_by(by), sample]
    rows = df.where(F.col(x).isNotNull())
    if center == "trimmed":
        mids = trim_mean(rows, x, 0.1, keys, tie).withColumnRenamed("trim_mean", "__c")
    elif center in ("mean", "median"):
        mids = rows.groupBy(*keys).agg((F.avg(x) if center == "mean" else F.percentile(x, F.lit(0.5))).alias("__c"))
    else:
        raise ValueError("center is mean, median or trimmed")
    away = rows.join(mids, keys).withColumn("__z", F.abs(F.col(x) - F.col("__c")))
    return f_oneway(away, "__z", sample, by)


def bartlett(df: DataFrame, x: str, sample: str, by=()) -> DataFrame:
    keys = _by(by)
    parts = df.where(F.col(x).isNotNull()).groupBy(*keys, sample).agg(F.count(x).alias("n"), F.var_samp(x).alias("v"))
    out = parts.groupBy(*keys).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("ss"),
        F.sum((F.col("n") - 1) * F.log("v")).alias("logs"),
        F.sum(F.try_divide(F.lit(1.0), F.col("n") - 1)).alias("inv"),
    )
    free = F.col("total") - F.col("k")
    top = free * F.log(F.try_divide(F.col("ss"), free)) - F.col("logs")
    scale = 1 + F.try_divide(F.col("inv") - F.try_divide(F.lit(1.0), free), 3 * (F.col("k") - 1))
    out = out.select(*keys, F.when(F.col("ss") > 0, F.try_divide(top, scale)).otherwise(0.0).alias("statistic"), (F.col("k") - 1).alias("df"))
    return out.withColumn("p_value", F.when(F.col("statistic") == 0, 1.0).otherwise(special.chi2_p_value(F.col("statistic"), F.col("df"))))


def linregress(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Least-squares line with r, the slope's two-sided p-value and both standard errors; null without spread in x."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    agg = _grouped(both, by).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mx"),
    )
    r = F.when(F.col("syy") == 0, 1.0).otherwise(F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    free = F.col("n") - 2
    error = F.sqrt(F.greatest(F.try_divide(F.col("syy") - F.col("slope") * F.col("sxy"), free), F.lit(0.0)) / F.col("sxx"))
    out = agg.where("sxx > 0").withColumn("rvalue", r).withColumn("stderr", error)
    t = F.when(F.col("stderr") > 0, F.col("slope") / F.col("stderr")).otherwise(float("inf"))
    return out.select(
        *_by(by), "slope", "intercept", "rvalue", special.t_p_value(t, free).alias("p_value"), "stderr",
        (F.col("stderr") * F.sqrt(F.col("sxx") / F.col("n") + F.col("mx") ** 2)).alias("intercept_stderr"),
    )


def _order_statistics(df: DataFrame, x: str, by, tie) -> DataFrame:
    """(by, x, tie, __i, __n): values with their rank and their group's size."""
    keys = _by(by)
    ranked = ranks(df.where(F.col(x).isNotNull()).select(*dict.fromkeys([*keys, x, *_by(tie)])), x, by, tie, "__i")
    return _beside(ranked, ranked.groupBy(*keys).agg(F.count("*").alias("__n")), keys)


def trim_mean(df: DataFrame, x: str, proportion: float, by=(), tie=()) -> DataFrame:
    """Mean without the floor(n p) least and largest values; two values at least."""
    if not 0 <= proportion < 0.5:
        raise ValueError("the proportion lies in [0, 0.5)")
    cut = F.floor(F.col("__n") * F.lit(proportion))
    rows = _order_statistics(df, x, by, tie).where((F.col("__i") > cut) & (F.col("__i") <= F.col("__n") - cut) & (F.col("__n") >= 2))
    return _grouped(rows, by).agg(F.avg(x).alias("trim_mean"))


def winsorized_mean(df: DataFrame, x: str, proportion: float, by=(), tie=()) -> DataFrame:
    """Mean with both tails set to the last value inside."""
    if not 0 <= proportion < 0.5:
        raise ValueError("the proportion lies in [0, 0.5)")
    cut = F.floor(F.col("__n") * F.lit(proportion))
    rows = _order_statistics(df, x, by, tie).where("__n >= 2")
    low = F.max(F.when(F.col("__i") == cut + 1, F.col(x)))
    high = F.max(F.when(F.col("__i") == F.col("__n") - cut, F.col(x)))
    held = _beside(rows, _grouped(rows, by).agg(low.alias("__low"), high.alias("__high")), _by(by))
    return _grouped(held.withColumn("__w", F.least(F.greatest(F.col(x), F.col("__low")), F.col("__high"))), by).agg(F.avg("__w").alias("winsorized_mean"))


def median_abs_deviation(df: DataFrame, x: str, by=(), scale: bool = False) -> DataFrame:
    """Median distance from the median; times 1.4826 (a fixed value) if scaled to a normal deviation."""
    keys = _by(by)
    mids = _grouped(df, by).agg(F.percentile(x, F.lit(0.5)).alias("__m"))
    joined = df.join(mids, keys) if keys else df.crossJoin(F.broadcast(mids))  # one row
    mad = F.percentile(F.abs(F.col(x) - F.col("__m")), F.lit(0.5))
    return joined.groupBy(*keys).agg((mad * (1.4826 if scale else 1.0)).alias("mad"))


def _slopes(df: DataFrame, x: str, y: str, by, id_col: str, both_ways: bool) -> DataFrame:
    """Slopes of the point pairs of each group. Quadratic in a group by definition: for groups of bounded size."""
    keys = _by(by)
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(id_col).alias("i"), F.col(x).alias("xi"), F.col(y).alias("yi"))
    b = a.select(*keys, F.col("i").alias("j"), F.col("xi").alias("xj"), F.col("yi").alias("yj"))
    pair = (F.col("i") != F.col("j")) if both_ways else (F.col("i") < F.col("j"))
    met = a.join(b, keys) if keys else a.crossJoin(b)
    return met.where(pair & (F.abs(F.col("xj") - F.col("xi")) > 1e-15)).select(*keys, "i", ((F.col("yj") - F.col("yi")) / (F.col("xj") - F.col("xi"))).alias("slope"))


def _line_through(df: DataFrame, x: str, y: str, slopes: DataFrame, by) -> DataFrame:
    keys = _by(by)
    joined = df.join(slopes, keys) if keys else df.crossJoin(F.broadcast(slopes))  # one row
    return joined.groupBy(*keys, "slope").agg(F.percentile(F.col(y) - F.col("slope") * F.col(x), F.lit(0.5)).alias("intercept"))


def theilslopes(df: DataFrame, x: str, y: str, by=(), id_col: str = "idx") -> DataFrame:
    """Median of the slopes of all point pairs, and the median intercept of lines with that slope."""
    slopes = _slopes(df, x, y, by, id_col, False).groupBy(*_by(by)).agg(F.percentile("slope", F.lit(0.5)).alias("slope"))
    return _line_through(df, x, y, slopes, by)


def siegelslopes(df: DataFrame, x: str, y: str, by=(), id_col: str = "idx") -> DataFrame:
    """Repeated medians: the upper median of each point's slopes, then their median."""
    keys = _by(by)
    s = _slopes(df, x, y, by, id_col, True)
    own = Window.partitionBy(*keys, "i")
    upper = s.withColumn("k", F.row_number().over(own.orderBy("slope"))).withColumn("n", F.count("*").over(own)).where(F.col("k") == F.floor(F.col("n") / 2) + 1)
    return _line_through(df, x, y, upper.groupBy(*keys).agg(F.percentile("slope", F.lit(0.5)).alias("slope")), by)
