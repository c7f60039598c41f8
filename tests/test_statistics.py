"""Statistics, information theory and distributions on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparksci.functions import distributions as D
from sparksci.functions import special, windows
from sparksci.operators import information as I
from sparksci.operators import statistics as S


def samples(spark, *groups):
    rows = [(f"g{k}", i, float(x)) for k, g in enumerate(groups) for i, x in enumerate(g)]
    return spark.createDataFrame(rows, "grp string, idx long, x double")


def one(df):
    return df.first().asDict()


def test_describe(spark):
    r = one(S.describe(samples(spark, range(1, 6)), "x"))
    assert (r["nobs"], r["min"], r["max"], r["mean"]) == (5, 1, 5, 3)
    assert r["variance"] == pytest.approx(2.5) and r["skewness"] == pytest.approx(0) and r["kurtosis"] == pytest.approx(-1.3)


def test_describe_of_constant_and_empty(spark):
    r = one(S.describe(samples(spark, [2, 2, 2, 2, 2]), "x"))
    assert (r["std"], r["skewness"], r["kurtosis"]) == (0, 0, 0)
    assert one(S.describe(samples(spark, []), "x"))["nobs"] == 0


def test_order_statistics(spark):
    df = samples(spark, range(1, 6))
    assert one(S.percentile(df, "x", 50))["percentile"] == 3
    assert one(S.iqr(df, "x"))["iqr"] == 2
    with pytest.raises(ValueError):
        S.percentile(df, "x", 101)
    ten = samples(spark, range(1, 11))
    assert one(S.trim_mean(ten, "x", 0.2, (), "idx"))["trim_mean"] == 5.5
    assert one(S.winsorized_mean(samples(spark, [*range(1, 10), 100]), "x", 0.1, (), "idx"))["winsorized_mean"] == 5.5
    assert one(S.median_abs_deviation(df, "x"))["mad"] == 1


def test_zscore(spark):
    z = [r["zscore"] for r in S.zscore(samples(spark, range(1, 6), [4, 4]), "x", "grp").orderBy("grp", "idx").collect()]
    assert sum(z[:5]) == pytest.approx(0) and z[5:] == [0, 0]


def test_t_tests(spark):
    r = one(S.ttest_1samp(samples(spark, [1.2, 1.5, 1.3, 1.4, 1.6]), "x", 1.0))
    assert r["statistic"] == pytest.approx(0.4 / (np.std([1.2, 1.5, 1.3, 1.4, 1.6], ddof=1) / math.sqrt(5))) and r["p_value"] < 0.05
    both = samples(spark, [1, 2, 3, 4, 5], [2, 3, 4, 5, 6])
    w = one(S.ttest_ind(both, "x", F.col("grp") == "g0"))
    assert w["statistic"] == pytest.approx(-1) and w["df"] == pytest.approx(8) and w["p_value"] == pytest.approx(0.34659, abs=1e-4)
    assert one(S.ttest_1samp(samples(spark, [1]), "x", 0.0))["statistic"] is None


def test_correlations(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(1, 6)], "idx long, x double, y double")
    assert one(S.pearsonr(df, "x", "y"))["statistic"] == pytest.approx(1)
    assert one(S.spearmanr(df, "x", "y", (), "idx"))["statistic"] == pytest.approx(1)
    r = one(S.linregress(df, "x", "y"))
    assert (r["slope"], r["intercept"], r["rvalue"]) == (pytest.approx(2), pytest.approx(0), pytest.approx(1))
    for f in (S.theilslopes, S.siegelslopes):
        r = one(f(df, "x", "y"))
        assert (r["slope"], r["intercept"]) == (pytest.approx(2), pytest.approx(0))


def test_spearman_ranks_ties_in_order(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.0, 2.0), (2, 2.0, 3.0)], "idx long, x double, y double")
    assert one(S.spearmanr(df, "x", "y", (), "idx"))["statistic"] == pytest.approx(1)
    assert one(S.spearmanr(df, "x", "y", (), "idx", True))["statistic"] < 1


def test_ranks_over_many_ranges(spark):
    """Groups, values and ties that several ranges share; null keys and values."""
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else f"g{g}", int(i), None if v == 9 else float(v)) for i, (g, v) in enumerate(zip(rng.choice([0, 0, 0, 0, 1, 2, 3], 600), rng.choice([1, 1, 1, 1, 2, 3, 9], 600)))]
    df = spark.createDataFrame(rows, "grp string, idx long, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["idx"]: (r["rank"], r["mean"]) for r in S.ranks(S.ranks(df, "x", "grp", "idx"), "x", "grp", "idx", "mean", True).collect()}
        whole = {r["idx"]: r["rank"] for r in S.ranks(df.select("idx", "x"), "x", (), "idx").collect()}
        ranges = df.repartitionByRange("grp", "x", "idx").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranges > 1
    low = lambda v: -math.inf if v is None else v
    assert whole == {i: k for k, (_, i, _) in enumerate(sorted(rows, key=lambda r: (low(r[2]), r[1])), 1)}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((low(v), i) for h, i, v in rows if h == g)
        for k, (v, i) in enumerate(own, 1):
            same = [j for j, (w, _) in enumerate(own, 1) if w == v]
            want[i] = (k, sum(same) / len(same))
    assert got == want
    assert S.ranks(df.limit(0), "x", "grp", "idx").count() == 0


def test_group_tests(spark):
    df = samples(spark, [1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [10, 11, 12, 13, 14])
    assert one(S.f_oneway(df, "x", "grp"))["p_value"] < 1e-4
    assert one(S.kruskal(df, "x", "grp", (), "idx"))["p_value"] < 0.05
    assert one(S.friedmanchisquare(df, "x", "grp", "idx"))["statistic"] == pytest.approx(10)
    spread = samples(spark, [1, 2, 3, 4, 5], [1, 10, 1, 10, 1, 10])
    for c in ("mean", "median", "trimmed"):
        assert one(S.levene(spread, "x", "grp", c, (), "idx"))["statistic"] > 1
    assert one(S.bartlett(spread, "x", "grp"))["p_value"] < 0.2


def test_normality(spark):
    assert 0 < one(S.shapiro(samples(spark, [-1.2, -0.5, 0, 0.3, 0.7, 1, 1.5, 2, -0.8, 0.2]), "x", (), "idx"))["statistic"] <= 1
    r = one(S.normaltest(samples(spark, [(i - 15) / 5 for i in range(30)]), "x"))
    assert r["statistic"] >= 0 and 0 <= r["p_value"] <= 1
    assert one(S.normaltest(samples(spark, range(5)), "x"))["statistic"] is None


def test_special_functions():
    assert special.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.f_sf(4.0, 2, 10) == pytest.approx(0.0529, abs=1e-3)
    assert special.normal_ppf(np.array([0.025, 0.5, 0.975])) == pytest.approx([-1.959963984540054, 0, 1.959963984540054], abs=1e-9)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329)


def test_information(spark):
    pmf = lambda *p: spark.createDataFrame([(float(a), float(b)) for a, b in p], "p double, q double")
    assert one(I.entropy(pmf(*[(0.25, 0.25)] * 4), "p"))["entropy"] == pytest.approx(math.log(4))
    assert one(I.entropy(pmf((1, 1), (0, 0)), "p"))["entropy"] == pytest.approx(0)
    assert one(I.kl_divergence(pmf((0.9, 0.1), (0.1, 0.9)), "p", "q"))["kl_divergence"] == pytest.approx(0.8 * math.log(9))
    xy = spark.createDataFrame([(float(i), float(i)) for i in range(1, 11)], "x double, y double")
    assert one(I.mutual_information(xy, "x", "y", (), 5))["mutual_information"] > 0
    lp = spark.createDataFrame([([-0.1, -2.0], 0), ([-1.0, -0.5], 1)], "lp array<double>, t int")
    assert one(I.nll_loss(lp, "lp", "t"))["nll_loss"] == pytest.approx(0.3)


@pytest.mark.parametrize(
    "d",
    [D.uniform(1, 3), D.exponential(2), D.laplace(1, 2), D.logistic(1, 2), D.cauchy(), D.weibull(1.5, 2), D.pareto(3), D.gumbel(), D.rayleigh(2), D.triangular(0, 1, 4),
     D.normal(1, 2), D.lognormal(0, 0.5), D.gamma(2.5, 2), D.chi2(4), D.beta(2, 3), D.student_t(5), D.f_distribution(4, 9)],
    ids=lambda d: d.name,
)
def test_quantiles_invert_cdfs(spark, d):
    df = spark.createDataFrame([(p,) for p in (0.05, 0.3, 0.5, 0.9)], "p double")
    back = [r[0] for r in df.select(d.cdf(d.quantile(F.col("p")))).collect()]
    assert back == pytest.approx([0.05, 0.3, 0.5, 0.9])
    # The density is the slope of the cdf.
    x = d.quantile(F.col("p"))
    slope = df.select(((d.cdf(x + 1e-5) - d.cdf(x - 1e-5)) / 2e-5).alias("s"), d.pdf(x).alias("p")).collect()
    assert [r["s"] for r in slope] == pytest.approx([r["p"] for r in slope], rel=1e-4)


def test_windows(spark):
    w = spark.range(1).select(windows.window("hann", 8), windows.kaiser(9, 5.0)).first()
    assert w[0] == pytest.approx([0.5 - 0.5 * math.cos(2 * math.pi * i / 8) for i in range(8)])
    assert w[1] == pytest.approx(np.kaiser(9, 5.0).tolist())


def test_counting_distributions(spark):
    df = spark.createDataFrame([(float(k),) for k in range(12)], "k double")
    for d, pmf in (
        (D.poisson(2.5), lambda k: math.exp(-2.5) * 2.5**k / math.factorial(k)),
        (D.binomial(9, 0.3), lambda k: math.comb(9, k) * 0.3**k * 0.7 ** (9 - k)),
        (D.geometric(0.4), lambda k: 0.4 * 0.6 ** (k - 1) if k else 0.0),
        (D.bernoulli(0.3), lambda k: (0.7, 0.3)[k] if k < 2 else 0.0),
        (D.discrete_uniform(2, 5), lambda k: 0.25 if 2 <= k <= 5 else 0.0),
    ):
        rows = df.select("k", d.pdf(F.col("k")).alias("p"), d.cdf(F.col("k")).alias("c")).orderBy("k").collect()
        want = [pmf(k) for k in range(12)]
        assert [r["p"] for r in rows] == pytest.approx(want, abs=1e-12)
        assert [r["c"] for r in rows] == pytest.approx(np.cumsum(want).tolist(), abs=1e-9)
        q = spark.createDataFrame([(0.5,), (0.95,)], "u double").select(d.quantile(F.col("u")).alias("q")).collect()
        assert [r["q"] for r in q] == [float(np.searchsorted(np.cumsum(want), u - 1e-12)) for u in (0.5, 0.95)]
