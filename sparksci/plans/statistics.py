"""Statistics, information theory and distributions over events and lineitem."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparksci.functions import distributions as D
from sparksci.functions import windows
from sparksci.operators import information as I
from sparksci.operators import statistics as S
from sparksci.plans.registry import query, r
from sparksci.sources.tables import table


def events(spark, d):
    return table(spark, d, "events")


def items(spark, d):
    return table(spark, d, "lineitem")


MOMENTS = """SELECT {by}, count({x}) AS nobs, avg({x}) AS m, var_pop({x}) AS v2, min({x}) AS lo, max({x}) AS hi, var_samp({x}) AS vs FROM {t} GROUP BY {by}"""
CENTRED = """WITH g AS (""" + MOMENTS + """),
c AS (SELECT e.{by}, avg(pow(e.{x} - g.m, 3)) AS m3, avg(pow(e.{x} - g.m, 4)) AS m4 FROM {t} e JOIN g ON e.{by} = g.{by} GROUP BY e.{by})
SELECT g.{by}, {out} FROM g JOIN c ON g.{by} = c.{by}"""


def _centred(by, x, t, out):
    return CENTRED.format(by=by, x=x, t=t, out=out)


DESCRIBE = ", ".join(
    ["nobs", r("lo", "min"), r("hi", "max"), r("m", "mean"), r("vs", "variance"), r("sqrt(vs)", "std"), r("m3 / pow(v2, 1.5)", "skewness"), r("m4 / pow(v2, 2) - 3", "kurtosis")]
)


@query("describe", _centred("event_type", "value", "events", DESCRIBE))
def _(spark, d):
    return S.describe(events(spark, d), "value", "event_type")


@query("describe_by_flag", _centred("l_returnflag", "l_quantity", "lineitem", DESCRIBE))
def _(spark, d):
    return S.describe(items(spark, d), "l_quantity", "l_returnflag")


@query("percentile", f"SELECT event_type, {r('quantile_cont(value, 0.9)', 'percentile')} FROM events GROUP BY event_type")
def _(spark, d):
    return S.percentile(events(spark, d), "value", 90, "event_type")


@query("median", f"SELECT event_type, {r('quantile_cont(value, 0.5)', 'median')} FROM events GROUP BY event_type")
def _(spark, d):
    return S.median(events(spark, d), "value", "event_type")


@query("iqr", f"SELECT event_type, {r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')} FROM events GROUP BY event_type")
def _(spark, d):
    return S.iqr(events(spark, d), "value", "event_type")


@query("skewness", _centred("event_type", "value", "events", r("m3 / pow(v2, 1.5)", "skewness")))
def _(spark, d):
    return S.skewness(events(spark, d), "value", "event_type")


@query("kurtosis", _centred("event_type", "value", "events", r("m4 / pow(v2, 2) - 3", "kurtosis")))
def _(spark, d):
    return S.kurtosis(events(spark, d), "value", "event_type")


@query("sem", f"SELECT event_type, {r('stddev_samp(value) / sqrt(count(value))', 'sem')} FROM events GROUP BY event_type")
def _(spark, d):
    return S.sem(events(spark, d), "value", "event_type")


@query("zscore", f"SELECT event_id, {r('(value - avg(value) OVER w) / stddev_samp(value) OVER w', 'zscore')} FROM events WINDOW w AS (PARTITION BY event_type)")
def _(spark, d):
    return S.zscore(events(spark, d), "value", "event_type").select("event_id", "zscore")


@query("ttest_1samp", f"SELECT event_type, {r('(avg(value) - 50) / (stddev_samp(value) / sqrt(count(value)))', 'statistic')}, count(value) - 1 AS df FROM events GROUP BY event_type")
def _(spark, d):
    return S.ttest_1samp(events(spark, d), "value", 50.0, "event_type").drop("p_value")


@query(
    "ttest_ind",
    f"""WITH g AS (SELECT l_returnflag, l_linestatus = 'F' AS a, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT x.l_returnflag, {r('(x.m - y.m) / sqrt(x.v / x.n + y.v / y.n)', 'statistic')} FROM g x JOIN g y ON x.l_returnflag = y.l_returnflag AND x.a AND NOT y.a""",
)
def _(spark, d):
    return S.ttest_ind(items(spark, d), "l_quantity", F.col("l_linestatus") == "F", "l_returnflag").where("statistic IS NOT NULL").select("l_returnflag", "statistic")


@query("ttest_rel", f"SELECT l_returnflag, {r('avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*)))', 'statistic')} FROM lineitem GROUP BY 1")
def _(spark, d):
    return S.ttest_rel(items(spark, d), "l_discount", "l_tax", "l_returnflag").select("l_returnflag", "statistic")


@query("pearsonr", f"SELECT l_returnflag, {r('corr(l_quantity, l_extendedprice)', 'statistic')} FROM lineitem GROUP BY 1")
def _(spark, d):
    return S.pearsonr(items(spark, d), "l_quantity", "l_extendedprice", "l_returnflag").select("l_returnflag", "statistic")


@query(
    "spearmanr",
    f"""WITH k AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS a,
row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS b FROM events)
SELECT event_type, {r('corr(a, b)', 'statistic')} FROM k GROUP BY 1""",
)
def _(spark, d):
    return S.spearmanr(events(spark, d), "value", "user_id", "event_type", "event_id").select("event_type", "statistic")


@query(
    "f_oneway",
    f"""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS m FROM g)
SELECT {r('(sum(n * pow(g.m - t.m, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'statistic')} FROM g, t""",
)
def _(spark, d):
    return S.f_oneway(events(spark, d), "value", "event_type").select("statistic")


@query(
    "kruskal",
    f"""WITH k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events),
g AS (SELECT user_id, event_type, count(*) AS n, sum(k)::DOUBLE AS s FROM k GROUP BY 1, 2)
SELECT user_id, {r('12.0::DOUBLE / (sum(n)::DOUBLE * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n)::DOUBLE + 1)', 'statistic')} FROM g GROUP BY 1""",
)
def _(spark, d):
    return S.kruskal(events(spark, d), "value", "event_type", "user_id", "event_id").select("user_id", "statistic")


@query(
    "friedmanchisquare",
    f"""WITH m AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2), f AS (SELECT user_id FROM m GROUP BY 1 HAVING count(*) = 5),
k AS (SELECT m.user_id, event_type, row_number() OVER (PARTITION BY m.user_id ORDER BY v, event_type) AS k FROM m JOIN f ON m.user_id = f.user_id),
s AS (SELECT event_type, sum(k)::DOUBLE AS s, count(*) AS n FROM k GROUP BY 1)
SELECT {r('12.0::DOUBLE / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3 * max(n) * (count(*) + 1)', 'statistic')} FROM s""",
)
def _(spark, d):
    sums = events(spark, d).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    whole = sums.groupBy("user_id").agg(F.count("*").alias("n")).where("n = 5").select("user_id")
    return S.friedmanchisquare(sums.join(whole, "user_id"), "v", "event_type", "user_id").select("statistic")


@query("shapiro")
def _(spark, d):
    return S.shapiro(events(spark, d), "value", "user_id", "event_id")


@query("normaltest_p")
def _(spark, d):
    return S.normaltest(events(spark, d), "value", "user_id")


@query(
    "levene",
    f"""WITH c AS (SELECT event_type, quantile_cont(value, 0.5) AS c FROM events GROUP BY 1),
z AS (SELECT e.event_type, abs(value - c) AS z FROM events e JOIN c ON e.event_type = c.event_type),
g AS (SELECT event_type, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS m FROM g)
SELECT {r('(sum(n * pow(g.m - t.m, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))', 'statistic')} FROM g, t""",
)
def _(spark, d):
    return S.levene(events(spark, d), "value", "event_type").select("statistic")


@query(
    "bartlett",
    f"""WITH g AS (SELECT event_type, count(*) AS n, var_samp(value) AS v FROM events GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS t, sum((n - 1) * v) AS ss, sum((n - 1) * ln(v)) AS lg, sum(1.0::DOUBLE / (n - 1)) AS i FROM g)
SELECT {r('((t - k) * ln(ss / (t - k)) - lg) / (1 + (i - 1.0::DOUBLE / (t - k)) / (3 * (k - 1)))', 'statistic')} FROM a""",
)
def _(spark, d):
    return S.bartlett(events(spark, d), "value", "event_type").select("statistic")


@query(
    "linregress",
    f"""SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 'slope')}, {r('regr_intercept(l_extendedprice, l_quantity)', 'intercept')},
{r('corr(l_extendedprice, l_quantity)', 'rvalue')} FROM lineitem GROUP BY 1""",
)
def _(spark, d):
    return S.linregress(items(spark, d), "l_quantity", "l_extendedprice", "l_returnflag").select("l_returnflag", "slope", "intercept", "rvalue")


RANKED = "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) "


@query("trim_mean", RANKED + f"SELECT event_type, {r('avg(value)', 'trim_mean')} FROM k WHERE i > floor(n * 0.1) AND i <= n - floor(n * 0.1) GROUP BY 1")
def _(spark, d):
    return S.trim_mean(events(spark, d), "value", 0.1, "event_type", "event_id")


@query(
    "winsorized_mean",
    RANKED
    + f""", e AS (SELECT event_type, max(CASE WHEN i = floor(n * 0.1) + 1 THEN value END) AS lo, max(CASE WHEN i = n - floor(n * 0.1) THEN value END) AS hi FROM k GROUP BY 1)
SELECT k.event_type, {r('avg(least(greatest(value, lo), hi))', 'winsorized_mean')} FROM k JOIN e ON k.event_type = e.event_type GROUP BY 1""",
)
def _(spark, d):
    return S.winsorized_mean(events(spark, d), "value", 0.1, "event_type", "event_id")


@query(
    "median_abs_deviation",
    f"""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1)
SELECT e.event_type, {r('quantile_cont(abs(value - m), 0.5) * 1.4826', 'mad')} FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1""",
)
def _(spark, d):
    return S.median_abs_deviation(events(spark, d), "value", "event_type", scale=True)


SLOPES = """WITH p AS (SELECT l_orderkey, l_linenumber AS i, l_quantity AS x, l_extendedprice / pi() AS y FROM lineitem),
s AS (SELECT a.l_orderkey, a.i, (b.y - a.y) / (b.x - a.x) AS s FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.i {op} b.i AND abs(b.x - a.x) > 1e-15), """
LINE = f"SELECT p.l_orderkey, {r('max(m.s)', 'slope')}, {r('quantile_cont(y - m.s * x, 0.5)', 'intercept')} FROM p JOIN m ON p.l_orderkey = m.l_orderkey GROUP BY 1"


@query("theilslopes", SLOPES.format(op="<") + "m AS (SELECT l_orderkey, quantile_cont(s, 0.5) AS s FROM s GROUP BY 1) " + LINE)
def _(spark, d):
    return S.theilslopes(items(spark, d).withColumn("y", F.col("l_extendedprice") / math.pi), "l_quantity", "y", "l_orderkey", "l_linenumber")


@query(
    "siegelslopes",
    SLOPES.format(op="<>")
    + """u AS (SELECT l_orderkey, i, s, row_number() OVER (PARTITION BY l_orderkey, i ORDER BY s) AS k, count(*) OVER (PARTITION BY l_orderkey, i) AS n FROM s),
m AS (SELECT l_orderkey, quantile_cont(s, 0.5) AS s FROM u WHERE k = floor(n / 2) + 1 GROUP BY 1) """
    + LINE,
)
def _(spark, d):
    return S.siegelslopes(items(spark, d).withColumn("y", F.col("l_extendedprice") / math.pi), "l_quantity", "y", "l_orderkey", "l_linenumber")


SHARES = "WITH c AS (SELECT event_type, user_id % 10 AS b, count(*)::DOUBLE AS n, sum(value) AS w FROM events GROUP BY 1, 2), p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p, w / sum(w) OVER (PARTITION BY event_type) AS q FROM c) "


def _shares(spark, d):
    c = events(spark, d).groupBy("event_type", (F.col("user_id") % 10).alias("b")).agg(F.count("*").alias("n"), F.sum("value").alias("w"))
    total = c.groupBy("event_type").agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    return c.join(total, "event_type").select("event_type", (F.col("n") / F.col("tn")).alias("p"), (F.col("w") / F.col("tw")).alias("q"))


@query("entropy", SHARES + f"SELECT event_type, {r('sum(-p * ln(greatest(p, 1e-300))) / ln(2)', 'entropy')} FROM p GROUP BY 1")
def _(spark, d):
    return I.entropy(_shares(spark, d), "p", "event_type", 2)


@query("kl_divergence", SHARES + f"SELECT event_type, {r('sum(p * (ln(p) - ln(q)))', 'kl_divergence')} FROM p GROUP BY 1")
def _(spark, d):
    return I.kl_divergence(_shares(spark, d), "p", "q", "event_type")


@query("cross_entropy", SHARES + f"SELECT event_type, {r('sum(-p * ln(q))', 'cross_entropy')} FROM p GROUP BY 1")
def _(spark, d):
    return I.cross_entropy(_shares(spark, d), "p", "q", "event_type")


@query("nll_loss", f"SELECT {r('-avg(embedding[label + 1]::DOUBLE)', 'nll_loss')} FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return I.nll_loss(v.select(F.transform("embedding", lambda x: x.cast("double")).alias("lp"), "label"), "lp", "label")


@query("differential_entropy")
def _(spark, d):
    return I.differential_entropy(events(spark, d), "value", "event_type", 3)


@query(
    "mutual_information",
    f"""WITH e AS (SELECT l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1),
b AS (SELECT l.l_returnflag, least(greatest(round((l_quantity - x0) / (x1 - x0) * 9), 0), 9)::INT AS i, least(greatest(round((l_extendedprice - y0) / (y1 - y0) * 9), 0), 9)::INT AS j
FROM lineitem l JOIN e ON l.l_returnflag = e.l_returnflag), j AS (SELECT l_returnflag, i, j, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
p AS (SELECT l_returnflag, n / sum(n) OVER (PARTITION BY l_returnflag) AS p, sum(n) OVER (PARTITION BY l_returnflag, i) / sum(n) OVER (PARTITION BY l_returnflag) AS px,
sum(n) OVER (PARTITION BY l_returnflag, j) / sum(n) OVER (PARTITION BY l_returnflag) AS py FROM j)
SELECT l_returnflag, {r('greatest(sum(p * ln(p / (px * py))), 0)', 'mutual_information')} FROM p GROUP BY 1""",
)
def _(spark, d):
    return I.mutual_information(items(spark, d), "l_quantity", "l_extendedprice", "l_returnflag", 10)


X = "((value - 50) / 25)"
CLOSED = [
    (D.uniform(-1, 2), f"CASE WHEN {X} BETWEEN -1 AND 2 THEN 1.0 / 3 ELSE 0 END", f"greatest(0, least(1, ({X} + 1) / 3))"),
    (D.exponential(0.5), f"CASE WHEN {X} >= 0 THEN 0.5 * exp(-0.5 * {X}) ELSE 0 END", f"CASE WHEN {X} >= 0 THEN 1 - exp(-0.5 * {X}) ELSE 0 END"),
    (D.laplace(0.5, 2), f"exp(-abs(({X} - 0.5) / 2)) / 4", f"CASE WHEN {X} < 0.5 THEN exp(({X} - 0.5) / 2) / 2 ELSE 1 - exp(-({X} - 0.5) / 2) / 2 END"),
    (D.logistic(0, 1), f"exp(-{X}) / pow(1 + exp(-{X}), 2)", f"1 / (1 + exp(-{X}))"),
    (D.cauchy(0, 1), f"1 / (pi() * (1 + {X} * {X}))", f"atan({X}) / pi() + 0.5"),
    (D.weibull(1.5, 2), f"CASE WHEN {X} >= 0 THEN 0.75 * pow({X} / 2, 0.5) * exp(-pow({X} / 2, 1.5)) ELSE 0 END", f"CASE WHEN {X} >= 0 THEN 1 - exp(-pow({X} / 2, 1.5)) ELSE 0 END"),
    (D.pareto(3, 1), f"CASE WHEN {X} >= 1 THEN 3 / pow({X}, 4) ELSE 0 END", f"CASE WHEN {X} >= 1 THEN 1 - pow({X}, -3) ELSE 0 END"),
    (D.gumbel(0, 1), f"exp(-{X} - exp(-{X}))", f"exp(-exp(-{X}))"),
    (D.rayleigh(1), f"CASE WHEN {X} >= 0 THEN {X} * exp(-{X} * {X} / 2) ELSE 0 END", f"CASE WHEN {X} >= 0 THEN 1 - exp(-{X} * {X} / 2) ELSE 0 END"),
]
for dist, pdf, cdf in CLOSED:

    @query(f"distribution_{dist.name}", f"SELECT event_id, {r(pdf, 'pdf')}, {r(cdf, 'cdf')} FROM events")
    def _(spark, d, dist=dist):
        x = (F.col("value") - 50) / 25
        return events(spark, d).select("event_id", dist.pdf(x).alias("pdf"), dist.cdf(x).alias("cdf"))


TAU = 2 * math.pi
for name, sql in (
    ("hann", f"0.5 - 0.5 * cos({TAU} * i / 64)"),
    ("hamming", f"0.54 - 0.46 * cos({TAU} * i / 64)"),
    ("blackman", f"0.42 - 0.5 * cos({TAU} * i / 64) + 0.08 * cos({2 * TAU} * i / 64)"),
):

    @query(f"{name}_window", f"SELECT i::INT AS i, {r(sql, 'w')} FROM range(64) t(i)")
    def _(spark, d, name=name):
        return spark.range(1).select(F.posexplode(windows.window(name, 64)).alias("i", "w"))


@query("kaiser_window")
def _(spark, d):
    return spark.range(1).select(F.posexplode(windows.kaiser(64, 8.6)).alias("i", "w"))
