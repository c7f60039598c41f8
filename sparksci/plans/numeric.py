"""Numerical methods, image filters, matrices and mixtures over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.functions import distributions as D
from sparksci.functions import numeric as N
from sparksci.operators import graph as G
from sparksci.operators import images as M
from sparksci.operators import matrix as X
from sparksci.operators import mixture
from sparksci.operators import series
from sparksci.operators import spatial as S
from sparksci.plans.graph import tree
from sparksci.plans.morphology import IMAGE, by_number, masked, pixels
from sparksci.plans.registry import query, r
from sparksci.plans.spatial import embedded
from sparksci.plans.statistics import events, items


def target():
    return F.col("value") / 50 + 1


@query("root_bisect", f"SELECT event_id, {r('sqrt(value / 50 + 1)', 'root')} FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", N.bisect(lambda x: x * x - target(), F.lit(0.0), target() + 1).alias("root"))


@query("root_newton", f"SELECT event_id, {r('sqrt(value / 50 + 1)', 'root')} FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", N.newton(lambda x: x * x - target(), lambda x: 2 * x, target()).alias("root"))


@query("root_secant", f"SELECT event_id, {r('sqrt(value / 50 + 1)', 'root')} FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", N.secant(lambda x: x * x - target(), target(), target() / 2 + 0.5).alias("root"))


@query("fixed_point", f"SELECT event_id, {r('sqrt(value / 50 + 1)', 'root')} FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", N.fixed_point(lambda x: (x + target() / x) / 2, target()).alias("root"))


@query("minimize_golden", f"SELECT event_id, {r('value / 50 + 1', 'x')} FROM events")
def _(spark, d):
    return events(spark, d).select("event_id", N.golden(lambda x: (x - target()) * (x - target()) + 3, target() - 5, target() + 7).alias("x"))


UP = r("exp(l_discount * 10) - 1", "integral")


for name, rule in (("fixed_quad", lambda f, a, b: N.fixed_quad(f, a, b, 8)), ("romberg", N.romberg), ("tanh_sinh", N.tanh_sinh)):

    @query(f"quadrature_{name}", f"SELECT l_orderkey, l_linenumber, {UP} FROM lineitem")
    def _(spark, d, rule=rule):
        return items(spark, d).select("l_orderkey", "l_linenumber", rule(F.exp, F.lit(0.0), F.col("l_discount") * 10).alias("integral"))


@query("ode_rk4", f"SELECT l_orderkey, l_linenumber, {r('l_quantity * exp(-2 * l_tax)', 'y')} FROM lineitem")
def _(spark, d):
    decay = lambda t, y: F.transform(y, lambda c: -c)
    return items(spark, d).select("l_orderkey", "l_linenumber", N.rk4(decay, F.lit(0.0), 2 * F.col("l_tax"), F.array("l_quantity"), 8)[0].alias("y"))


@query("ode_verlet")
def _(spark, d):
    s = N.verlet(lambda q: -q, F.col("l_tax"), F.col("l_discount"), 0.05, 40)
    return items(spark, d).select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.q", "s.p")


@query("halton", f"SELECT i::BIGINT AS i, {r('list_sum(list_transform(range(12), lambda k: ((i // (1 << k)) % 2) / (2.0::DOUBLE ** (k + 1))))', 'a')} FROM range(1000) t(i)")
def _(spark, d):
    return spark.range(1000).select(F.col("id").alias("i"), N.halton(F.col("id"), (2,))[0].alias("a"))


T = "(l_discount * 10)"


@query("bezier", f"SELECT l_orderkey, l_linenumber, {r(f'3 * {T} * pow(1 - {T}, 2) * 1 + 3 * {T} * {T} * (1 - {T}) * 2 + pow({T}, 3) * 4', 'x')} FROM lineitem")
def _(spark, d):
    t = F.col("l_discount") * 10
    return items(spark, d).select("l_orderkey", "l_linenumber", N.bezier([[0.0], [1.0], [2.0], [4.0]], t)[0].alias("x"))


@query("bspline")
def _(spark, d):
    t = F.col("l_discount") * 10
    return items(spark, d).select("l_orderkey", "l_linenumber", N.bspline([[0.0], [1.0], [2.0], [4.0]], [0.0, 0, 0, 0.5, 1, 1, 1], 2, t)[0].alias("x"))


NEAR = """, n AS (SELECT img, y, x, v, CASE WHEN x = 0 THEN 1 ELSE x - 1 END AS xl, CASE WHEN x = 23 THEN 22 ELSE x + 1 END AS xr, CASE WHEN y = 0 THEN 1 ELSE y - 1 END AS yu,
CASE WHEN y = 23 THEN 22 ELSE y + 1 END AS yd FROM a) """
L, R, U, B = (f"(SELECT {c}.v FROM a {c} WHERE {c}.img = n.img AND {c}.y = n.{y} AND {c}.x = n.{x})" for c, y, x in (("l", "y", "xl"), ("r", "y", "xr"), ("u", "yu", "x"), ("b", "yd", "x")))


@query("laplace", IMAGE + NEAR + f"SELECT img, y, x, {r(f'{L} + {R} + {U} + {B} - 4 * v', 'v')} FROM n")
def _(spark, d):
    return M.laplace(pixels(spark, d))


for name in ("sobel", "prewitt"):

    @query(name)
    def _(spark, d, name=name):
        return getattr(M, name)(pixels(spark, d))


@query("gaussian_laplace")
def _(spark, d):
    return M.gaussian_laplace(pixels(spark, d))


@query("gaussian_gradient_magnitude")
def _(spark, d):
    return M.gaussian_gradient_magnitude(pixels(spark, d))


MASK = IMAGE + ", m AS (SELECT img, y, x, CASE WHEN v > 400 THEN 1 ELSE 0 END AS v FROM a) "
for name, sql in (("euclidean", "sqrt(min(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)))"), ("cityblock", "min(abs(a.y - b.y) + abs(a.x - b.x))"), ("chessboard", "min(greatest(abs(a.y - b.y), abs(a.x - b.x)))")):

    @query(
        f"distance_transform_{name}",
        MASK + f"SELECT a.img, a.y, a.x, {r(sql + '::DOUBLE', 'v')} FROM m a LEFT JOIN m b ON a.img = b.img AND b.v <> 0 GROUP BY 1, 2, 3",
    )
    def _(spark, d, name=name):
        return M.distance_transform(masked(spark, d), name)


@query("binary_fill_holes")
def _(spark, d):
    return M.binary_fill_holes(by_number(masked(spark, d)))


@query("heat", IMAGE + NEAR + f"SELECT img, y, x, {r(f'CASE WHEN x IN (0, 23) OR y IN (0, 23) THEN v ELSE v + 0.2 * ({L} + {R} + {U} + {B} - 4 * v) END', 'v')} FROM n")
def _(spark, d):
    return M.heat(pixels(spark, d), 0.2, 1)


COO = "WITH a AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) "


def coo(spark, d):
    return items(spark, d).groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query("matrix_multiply", COO + f"SELECT a.i, b.i AS j, {r('sum(a.v * b.v)', 'v')} FROM a JOIN a b ON a.j = b.j GROUP BY 1, 2")
def _(spark, d):
    return X.multiply(coo(spark, d), X.transpose(coo(spark, d)))


@query("matrix_frobenius", COO + f"SELECT {r('sqrt(sum(v * v))', 'norm')} FROM a")
def _(spark, d):
    return X.frobenius(coo(spark, d))


@query("gram_matrix", "WITH e AS (SELECT unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i, vec_id FROM embeddings) " + f"SELECT a.i::INT AS i, b.i::INT AS j, {r('sum(a.p * b.p)', 'v')} FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY 1, 2")
def _(spark, d):
    return X.gram(embedded(spark, d))


@query("conjugate_gradient")
def _(spark, d):
    a = X.add(X.gram(embedded(spark, d)), spark.range(64).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v")))
    return X.conjugate_gradient(a, spark.range(64).select(F.col("id").alias("i"), F.lit(1.0).alias("v")), max_iter=30)[0]


@query("gaussian_mixture")
def _(spark, d):
    p = embedded(spark, d)
    starts = [row["v"] for row in p.orderBy("id").limit(3).collect()]
    return mixture.predict(p, mixture.fit(p, starts, "diagonal", 10)).select("id", "label", "score")


@query("betweenness_centrality")
def _(spark, d):
    e = tree(spark, d)
    e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return G.betweenness_centrality(e, G.nodes_of(e), False)


# One level of the four-tap transform, written out over lists: three values more at the left with the end value, three at the right without it.
DB2 = """WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS v, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT user_id, n, list_transform([2, 1, 0], lambda i: v[CASE WHEN i < n THEN i ELSE greatest(2 * n - 2 - i, 0) END + 1]) || v || list_transform([0, 1, 2], lambda i: v[CASE WHEN n > 1 + i THEN n - 2 - i ELSE i % n END + 1]) AS e FROM s),
p AS (SELECT user_id, e, unnest(range(0, n + 3, 2)) AS k FROM x)
SELECT user_id, k // 2 AS pos,
round(0.48296291314469025 * e[k + 1] + 0.836516303737469 * e[k + 2] + 0.22414386804185735 * e[k + 3] - 0.12940952255092145 * e[k + 4], 4) + 0.0 AS approx,
round(-0.12940952255092145 * e[k + 1] - 0.22414386804185735 * e[k + 2] + 0.836516303737469 * e[k + 3] - 0.48296291314469025 * e[k + 4], 4) + 0.0 AS detail FROM p"""


@query("dwt_db2", DB2)
def _(spark, d):
    return series.dwt(events(spark, d), "value", "event_id", "user_id", "db2")


@query("convex_hull")
def _(spark, d):
    return S.convex_hull(events(spark, d).select("event_type", F.array("value", F.col("user_id").cast("double")).alias("v")), "event_type")


@query(
    "map_coordinates",
    IMAGE
    + f"""SELECT a.img, (a.y * 24 + a.x)::INT AS qid, {r('0.5 * a.v + 0.5 * b.v', 'value')} FROM a JOIN a b ON a.img = b.img AND a.y = b.y AND b.x = least(a.x + 1, 23)""",
)
def _(spark, d):
    p = pixels(spark, d)
    asked = p.select("img", (F.col("y") * 24 + F.col("x")).alias("qid"), F.col("y").cast("double").alias("yq"), (F.col("x") + 0.5).alias("xq"))
    return M.map_coordinates(p, asked)


def resampled(yq: str, xq: str, height: int = 24, width: int = 24) -> str:
    """SQL of images whose pixels take the bilinear values at (yq, xq) of the old ones."""
    return IMAGE + f""", q AS (SELECT i.img, y.range::INT AS y, x.range::INT AS x, greatest(0, least(23, {yq})) AS yq, greatest(0, least(23, {xq})) AS xq
FROM (SELECT DISTINCT img FROM a) i, range({height}) y, range({width}) x)
SELECT q.img, q.y, q.x, {r('sum((1 - abs(a.y - q.yq)) * (1 - abs(a.x - q.xq)) * a.v)', 'v')}
FROM q JOIN a ON q.img = a.img AND abs(a.y - q.yq) < 1 AND abs(a.x - q.xq) < 1 GROUP BY 1, 2, 3"""


C30, S30 = "cos(radians(30))", "sin(radians(30))"
RESAMPLED = {
    "affine_transform": (
        lambda p: M.affine_transform(p, [[0.83717, 0.11323], [-0.09127, 0.91711]], (1.71313, 0.37171)),
        resampled("0.83717::DOUBLE * y.range + 0.11323::DOUBLE * x.range + 1.71313::DOUBLE", "-0.09127::DOUBLE * y.range + 0.91711::DOUBLE * x.range + 0.37171::DOUBLE"),
    ),
    "zoom": (lambda p: M.zoom(p, (1.5, 2.0)), resampled("y.range / 1.5::DOUBLE", "x.range / 2.0::DOUBLE", 36, 48)),
    "shift": (lambda p: M.shift(p, (0.5, -1.0)), resampled("y.range - 0.5::DOUBLE", "x.range + 1.0::DOUBLE")),
    # 24 * (cos + sin) of 30 degrees is 32.8.
    "rotate": (
        lambda p: M.rotate(p, 30.0, reshape=True),
        resampled(f"11.5::DOUBLE + {C30} * (y.range - 16) + {S30} * (x.range - 16)", f"11.5::DOUBLE - {S30} * (y.range - 16) + {C30} * (x.range - 16)", 33, 33),
    ),
}
for name, (fn, sql) in RESAMPLED.items():

    @query(name, sql)
    def _(spark, d, fn=fn):
        return fn(pixels(spark, d))


Z = "((value - 50) / 25)"
DENSITIES = [
    (D.normal(), f"exp(-{Z} * {Z} / 2) / sqrt(2 * pi())"),
    (D.lognormal(), f"CASE WHEN {Z} > 0 THEN exp(-pow(ln(CASE WHEN {Z} > 0 THEN {Z} ELSE 1 END), 2) / 2) / ({Z} * sqrt(2 * pi())) ELSE 0 END"),
    (D.gamma(3, 1), f"CASE WHEN {Z} > 0 THEN {Z} * {Z} * exp(-{Z}) / 2 ELSE 0 END"),
    (D.chi2(4), f"CASE WHEN {Z} > 0 THEN {Z} * exp(-{Z} / 2) / 4 ELSE 0 END"),
    (D.beta(2, 3), f"CASE WHEN {Z} > 0 AND {Z} < 1 THEN 12 * {Z} * pow(1 - {Z}, 2) ELSE 0 END"),
    (D.student_t(3), f"2 / (pi() * sqrt(3) * pow(1 + {Z} * {Z} / 3, 2))"),
]
for dist, pdf in DENSITIES:

    @query(f"density_{dist.name}", f"SELECT event_id, {r(pdf, 'pdf')} FROM events")
    def _(spark, d, dist=dist):
        return events(spark, d).select("event_id", dist.pdf((F.col("value") - 50) / 25).alias("pdf"))

    @query(f"tail_{dist.name}")
    def _(spark, d, dist=dist):
        return events(spark, d).select("event_id", dist.sf((F.col("value") - 50) / 25).alias("sf"))


for dist in (D.poisson(2.5), D.binomial(9, 0.3), D.geometric(0.4), D.discrete_uniform(2, 5), D.bernoulli(0.3)):

    @query(f"counts_{dist.name}")
    def _(spark, d, dist=dist):
        k = (F.col("event_id") % 12).cast("double")
        return events(spark, d).select("event_id", dist.pdf(k).alias("pmf"), dist.cdf(k).alias("cdf"))
