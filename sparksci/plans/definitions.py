"""SQL counterparts, written from the definitions, of queries registered elsewhere without one; and a few queries more."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.functions import distributions as D
from sparksci.functions import vectors as V
from sparksci.operators import flow
from sparksci.operators import graph as G
from sparksci.operators import series as S
from sparksci.plans.graph import BOTH, TREE
from sparksci.plans.morphology import IMAGE, MASK
from sparksci.plans.registry import ORACLES, query, r
from sparksci.plans.series import KNOTS, lines
from sparksci.plans.statistics import events, items
from sparksci.sources.tables import table

# --- series ----------------------------------------------------------------------------------

ORACLES["savgol_filter"] = f"""WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS v, count(*) AS n FROM events GROUP BY 1), p AS (SELECT user_id, v, n, unnest(range(n)) AS pos FROM s),
t AS (SELECT user_id, pos, v, n, list_transform([-2, -1, 0, 1, 2], lambda j: CASE WHEN pos + j < 0 THEN -(pos + j) WHEN pos + j >= n THEN 2 * n - 2 - pos - j ELSE pos + j END) AS ix FROM p)
SELECT user_id, pos, {r('(-3 * v[ix[1] + 1] + 12 * v[ix[2] + 1] + 17 * v[ix[3] + 1] + 12 * v[ix[4] + 1] - 3 * v[ix[5] + 1]) / 35', 'value')} FROM t"""

#: Half-overlapping segments of 64 values without their means, weighed by a symmetric Hann window; their transforms at all 33 frequencies.
SEGMENTS = """WITH o AS (SELECT event_type, value AS x, user_id::DOUBLE AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
u AS (SELECT *, unnest(range(greatest(0, i // 32 - 2), i // 32 + 1)) AS k FROM o), g AS (SELECT event_type, n, k, i - 32 * k AS j, x, y FROM u WHERE i - 32 * k < 64 AND 32 * k + 64 <= n),
h AS (SELECT event_type, k, j, (x - avg(x) OVER w) * t AS x, (y - avg(y) OVER w) * t AS y FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 63) AS t FROM g) WINDOW w AS (PARTITION BY event_type, k)),
f AS (SELECT event_type, k, b.range AS bin, sum(x * cos(2 * pi() * ((b.range * j) % 64) / 64)) AS xr, -sum(x * sin(2 * pi() * ((b.range * j) % 64) / 64)) AS xi, sum(y * cos(2 * pi() * ((b.range * j) % 64) / 64)) AS yr, -sum(y * sin(2 * pi() * ((b.range * j) % 64) / 64)) AS yi FROM h JOIN range(33) b ON true GROUP BY 1, 2, 3),
z AS (SELECT event_type, bin, CASE WHEN bin IN (0, 32) THEN 1.0 ELSE 2.0 END / (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * range / 63), 2)) FROM range(64)) AS c, avg(xr * yr + xi * yi) AS re, avg(xr * yi - xi * yr) AS im, avg(xr * xr + xi * xi) AS pxx, avg(yr * yr + yi * yi) AS pyy FROM f GROUP BY 1, 2) """
ORACLES["welch"] = SEGMENTS + f"SELECT event_type, bin, {r('bin / 64', 'freq')}, {r('c * pxx', 'psd')} FROM z"
ORACLES["csd"] = SEGMENTS + f"SELECT event_type, bin, {r('bin / 64', 'freq')}, {r('c * re', 're')}, {r('c * im', 'im')}, {r('c * pxx', 'pxx')}, {r('c * pyy', 'pyy')} FROM z"
ORACLES["coherence"] = SEGMENTS + f"SELECT event_type, bin, {r('bin / 64', 'freq')}, {r('(re * re + im * im) / (pxx * pyy)', 'coherence')} FROM z"

#: Frames of 64 values, 16 apart, weighed by a periodic Hann window.
FRAMES = """WITH o AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
u AS (SELECT *, unnest(range(greatest(0, i // 16 - 4), i // 16 + 1)) AS k FROM o), g AS (SELECT event_type, k AS frame, i - 16 * k AS j, x * (0.5 - 0.5 * cos(2 * pi() * (i - 16 * k) / 64)) AS x FROM u WHERE i - 16 * k < 64 AND 16 * k + 64 <= n),
f AS (SELECT event_type, frame, b.range AS bin, sum(x * cos(2 * pi() * ((b.range * j) % 64) / 64)) AS re, -sum(x * sin(2 * pi() * ((b.range * j) % 64) / 64)) AS im FROM g JOIN range(33) b ON true GROUP BY 1, 2, 3) """
ORACLES["stft"] = FRAMES + f"SELECT event_type, frame, bin, {r('re', 're')}, {r('im', 'im')} FROM f"
ORACLES["spectrogram"] = FRAMES + f"SELECT event_type, frame, bin, {r('re * re + im * im', 'power')} FROM f"

# --- interpolation ---------------------------------------------------------------------------

PCHIP = """WITH k AS (SELECT user_id, event_id, event_id::DOUBLE AS x, value AS y FROM events),
h AS (SELECT *, lead(x) OVER w - x AS h, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS d FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x)),
t AS (SELECT *, lag(h) OVER w AS h0, lag(d) OVER w AS d0, lag(h, 2) OVER w AS hb, lag(d, 2) OVER w AS db, lead(h) OVER w AS ha, lead(d) OVER w AS da FROM h WINDOW w AS (PARTITION BY user_id ORDER BY x)),
e AS (SELECT *, ((2 * h + ha) * d - h * da) / (h + ha) AS ml, ((2 * h0 + hb) * d0 - h0 * db) / (h0 + hb) AS mr FROM t),
s AS (SELECT user_id, event_id, x, y, CASE WHEN d0 IS NOT NULL AND d IS NOT NULL THEN CASE WHEN d0 * d <= 0 THEN 0 ELSE 3 * (h0 + h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) END
WHEN d0 IS NULL AND d IS NULL THEN 0
WHEN d0 IS NULL THEN CASE WHEN da IS NULL THEN d WHEN ml * d <= 0 THEN 0 WHEN d * da <= 0 AND abs(ml) > 3 * abs(d) THEN 3 * d ELSE ml END
ELSE CASE WHEN db IS NULL THEN d0 WHEN mr * d0 <= 0 THEN 0 WHEN d0 * db <= 0 AND abs(mr) > 3 * abs(d0) THEN 3 * d0 ELSE mr END END AS m FROM e) """
ORACLES["pchip_slopes"] = PCHIP + f"SELECT user_id, event_id, {r('m', 'slope')} FROM s"
ORACLES["pchip_interpolate"] = PCHIP + f""", n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lag(m) OVER w AS mp FROM s WINDOW w AS (PARTITION BY user_id ORDER BY x)),
b AS (SELECT user_id, event_id, y, x + 0.3 AS q, CASE WHEN x1 IS NULL THEN xp ELSE x END AS xa, CASE WHEN x1 IS NULL THEN yp ELSE y END AS ya, CASE WHEN x1 IS NULL THEN mp ELSE m END AS ma, coalesce(x1, x) AS xb, coalesce(y1, y) AS yb, coalesce(m1, m) AS mb FROM n),
u AS (SELECT *, xb - xa AS h, (q - xa) / (xb - xa) AS t FROM b)
SELECT user_id, event_id, {r('coalesce((2 * t * t * t - 3 * t * t + 1) * ya + (t * t * t - 2 * t * t + t) * h * ma + (3 * t * t - 2 * t * t * t) * yb + (t * t * t - t * t) * h * mb, y)', 'value')} FROM u"""

# --- images ----------------------------------------------------------------------------------


def correlated(source: str, name: str, taps: str, place: str = "true") -> str:
    """CTE ``name``: source correlated with taps (dy, dx, w), borders reflected without the border itself."""
    to = lambda c: f"(23 - abs(23 - abs(a.{c} + k.d{c})))"
    return f", {name} AS (SELECT a.img, a.y, a.x, sum(k.w * b.v) AS v FROM {source} a JOIN ({taps}) k ON {place} JOIN {source} b ON b.img = a.img AND b.y = {to('y')} AND b.x = {to('x')} GROUP BY 1, 2, 3)"


def values(rows: list[tuple[int, int, float]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in rows) + ") t(dy, dx, w)"


PIXELS = " SELECT img, y, x, round(v, 4) + 0.0 AS v FROM "
for name, side in (("sobel", 2), ("prewitt", 1)):
    taps = values([(dy, dx, dx * (side if dy == 0 else 1)) for dy in (-1, 0, 1) for dx in (-1, 1)])
    ORACLES[name] = IMAGE + correlated("a", "g", taps) + PIXELS + "g"
BELL = "SELECT {to}, exp(-range * range / 2.0) / (SELECT sum(exp(-range * range / 2.0)) FROM range(-4, 5)) AS w FROM range(-4, 5)"
FALL = "SELECT {to}, -range * exp(-range * range / 2.0) / (SELECT sum(exp(-range * range / 2.0)) FROM range(-4, 5)) AS w FROM range(-4, 5)"
ALONG_X, ALONG_Y = "0 AS dy, range AS dx", "range AS dy, 0 AS dx"
SMOOTH = correlated("a", "sx", BELL.format(to=ALONG_X)) + correlated("sx", "sy", BELL.format(to=ALONG_Y))
ORACLES["gaussian_laplace"] = IMAGE + SMOOTH + correlated("sy", "l", values([(-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)])) + PIXELS + "l"
ORACLES["gaussian_gradient_magnitude"] = (
    IMAGE + correlated("a", "fx", FALL.format(to=ALONG_X)) + correlated("fx", "gx", BELL.format(to=ALONG_Y)) + correlated("a", "fy", FALL.format(to=ALONG_Y)) + correlated("fy", "gy", BELL.format(to=ALONG_X))
    + f" SELECT gx.img, gx.y, gx.x, {r('sqrt(gx.v * gx.v + gy.v * gy.v)', 'v')} FROM gx JOIN gy ON gx.img = gy.img AND gx.y = gy.y AND gx.x = gy.x"
)

#: Images numbered by name; connected pixels share the least place (24 y + x) that they reach.
NUMBERED = MASK + ", i AS (SELECT dense_rank() OVER (ORDER BY img)::BIGINT AS img, y, x, v FROM m), p AS (SELECT img, y, x FROM i WHERE v <> 0)"
LABELS = (
    NUMBERED
    + """, g AS (WITH RECURSIVE r(img, y, x, root) AS (SELECT img, y, x, y * 24 + x FROM p UNION SELECT p.img, p.y, p.x, r.root FROM r JOIN p ON p.img = r.img AND abs(p.y - r.y) + abs(p.x - r.x) = 1) SELECT img, y, x, min(root) AS root FROM r GROUP BY 1, 2, 3),
b AS (SELECT i.img, i.y, i.x, i.v, CASE WHEN root IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY i.img ORDER BY root NULLS LAST) END::BIGINT AS label FROM i LEFT JOIN g ON g.img = i.img AND g.y = i.y AND g.x = i.x) """
)
ORACLES["label"] = LABELS + f"SELECT img, y, x, {r('v', 'v')}, label FROM b"
ORACLES["find_objects"] = LABELS + "SELECT img, label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1, count(*) AS area FROM b WHERE label > 0 GROUP BY 1, 2"
ORACLES["label_statistics"] = LABELS + f"SELECT img, label, {r('sum(v)', 'sum')}, {r('avg(v)', 'mean')}, {r('sum(v * y) / sum(v)', 'cy')}, {r('sum(v * x) / sum(v)', 'cx')} FROM b WHERE label > 0 GROUP BY 1, 2"
ORACLES["binary_fill_holes"] = NUMBERED + """, o AS (SELECT img, y, x FROM i WHERE v = 0),
s AS (WITH RECURSIVE r(img, y, x) AS (SELECT img, y, x FROM o WHERE y IN (0, 23) OR x IN (0, 23) UNION SELECT o.img, o.y, o.x FROM r JOIN o ON o.img = r.img AND abs(o.y - r.y) + abs(o.x - r.x) = 1) SELECT * FROM r)
SELECT i.img, i.y, i.x, CASE WHEN s.img IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM i LEFT JOIN s ON s.img = i.img AND s.y = i.y AND s.x = i.x"""

# --- graphs ----------------------------------------------------------------------------------

ORACLES["closeness_centrality"] = TREE + f""", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT src AS s, w FROM e UNION ALL SELECT a.src, a.w + b.w FROM e a JOIN e b ON b.src = a.dst)
SELECT id, {r('coalesce(count(w) / nullif(sum(w), 0), 0)', 'centrality')} FROM n LEFT JOIN d ON d.s = n.id GROUP BY 1"""
#: In a tree a node lies on the paths between any two of its branches.
ORACLES["betweenness_centrality"] = TREE + f""", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), t AS (SELECT count(*)::DOUBLE AS n FROM n),
c AS (SELECT src AS id, count(*)::DOUBLE AS k FROM e WHERE src >= 20000000 GROUP BY 1), g AS (SELECT e.src AS region, e.dst AS id, coalesce(k, 0)::DOUBLE AS k FROM e LEFT JOIN c ON c.id = e.dst WHERE e.src < 20000000 AND e.dst >= 20000000),
z AS (SELECT region, 1 + sum(1 + k) AS size FROM g GROUP BY 1),
p AS (SELECT g.id, (pow(size - 1, 2) - k - pow(size - 1 - k, 2)) / 2 AS pairs FROM g JOIN z ON z.region = g.region UNION ALL SELECT g.region, (pow(any_value(size) - 1, 2) - sum(pow(1 + k, 2))) / 2 FROM g JOIN z ON z.region = g.region GROUP BY 1)
SELECT n.id, {r('coalesce(pairs, 0) * 2 / ((t.n - 1) * (t.n - 2))', 'centrality')} FROM n CROSS JOIN t LEFT JOIN p ON p.id = n.id"""


def _power_sql(steps: int) -> str:
    parts = [BOTH.rstrip() + ", v0 AS MATERIALIZED (SELECT id, 1 / sqrt((SELECT count(*) FROM n)) AS v FROM n)"]
    for k in range(steps):
        parts.append(f"s{k} AS MATERIALIZED (SELECT n.id, coalesce(s, 0) AS s FROM n LEFT JOIN (SELECT src, sum(w * v) AS s FROM e JOIN v{k} ON v{k}.id = e.dst GROUP BY 1) ON src = n.id)")
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT id, s / sqrt((SELECT sum(s * s) FROM s{k})) AS v FROM s{k})")
    return ", ".join(parts) + f" SELECT id, {r('abs(v)', 'centrality')} FROM v{steps}"


ORACLES["eigenvector_centrality"] = _power_sql(100)

#: Rings of customers: cycles for components.
RING = """WITH c AS (SELECT c_custkey::BIGINT AS id, lead(c_custkey) OVER w AS up, first_value(c_custkey) OVER w AS first, (c_custkey % 7 + 1)::DOUBLE AS w FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_custkey % 10 ORDER BY c_custkey)),
e AS (SELECT id AS src, coalesce(up, first)::BIGINT AS dst, w, first AS g FROM c) """


def ring(spark, d):
    """Customers of a nation whose numbers end alike, in a directed ring, weighted."""
    w = Window.partitionBy("c_nationkey", F.col("c_custkey") % 10).orderBy("c_custkey")
    least = F.first("c_custkey").over(w)
    return table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("src"), F.coalesce(F.lead("c_custkey").over(w), least).cast("long").alias("dst"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))


@query("connected_rings", RING + "SELECT id, first::BIGINT AS component FROM c")
def _(spark, d):
    e = ring(spark, d)
    return G.connected_components(e, G.nodes_of(e))


#: From all nations by way of their customers to one sink: in a tree a node passes on no more than its way in and its ways out.
@query(
    "max_flow",
    f"""WITH o AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n FROM orders GROUP BY 1), c AS (SELECT c_nationkey AS g, sum(least(c_custkey % 7 + 1, coalesce(n, 0))) AS out FROM customer LEFT JOIN o ON o.id = c_custkey GROUP BY 1)
SELECT {r('sum(least(100 + 3 * g, out))::DOUBLE', 'flow')}, {r('sum(least(100 + 3 * g, out))::DOUBLE', 'cut')} FROM c""",
)
def _(spark, d):
    e = network(spark, d)
    total, used = flow.max_flow(e, -2, -1)
    return flow.min_cut(e, used, -2).agg(F.lit(total).alias("flow"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("cut"))


def network(spark, d):
    """(src, dst, w): source -2 to nations, nations to customers, customers to sink -1 by their number of orders."""
    customer = table(spark, d, "customer")
    nation = (F.col("c_nationkey") + 20_000_000).cast("long")
    first = customer.select(F.lit(-2).cast("long").alias("src"), nation.alias("dst"), (100 + 3 * F.col("c_nationkey")).cast("double").alias("w")).distinct()
    second = customer.select(nation.alias("src"), F.col("c_custkey").cast("long").alias("dst"), (F.col("c_custkey") % 7 + 1).cast("double").alias("w"))
    third = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("src")).agg(F.count("*").cast("double").alias("w")).select("src", F.lit(-1).cast("long").alias("dst"), "w")
    return first.unionByName(second).unionByName(third)


#: A customer costs 1 to 3 a unit: each nation fills its cheapest customers first, as far as its own way in lets it.
@query(
    "min_cost_flow",
    f"""WITH o AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n FROM orders GROUP BY 1),
c AS (SELECT c_nationkey AS g, c_custkey % 3 + 1 AS k, sum(least(c_custkey % 7 + 1, coalesce(n, 0))) AS room FROM customer LEFT JOIN o ON o.id = c_custkey GROUP BY 1, 2),
s AS (SELECT g, k, greatest(0, least(room, 100 + 3 * g - coalesce(sum(room) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS f FROM c)
SELECT (g + 20000000)::BIGINT AS nation, {r('sum(f)::DOUBLE', 'flow')}, {r('sum(f * k)::DOUBLE', 'cost')} FROM s GROUP BY 1 HAVING sum(f) > 0""",
)
def _(spark, d):
    cost = F.when(F.col("src") >= 20_000_000, F.col("dst") % 3 + 1).otherwise(0).cast("double")
    used = flow.min_cost_flow(network(spark, d).withColumn("cost", cost), -2, -1)[2]
    return used.where("src >= 20000000").groupBy(F.col("src").alias("nation")).agg(F.sum("flow").alias("flow"), F.sum(F.col("flow") * F.col("cost")).alias("cost"))


# --- distributions ---------------------------------------------------------------------------

Z = "((value - 50) / 25)"
#: Simpson's rule from 0 to |x| over the normal density.
NORMAL_TAIL = "(0.5 - sign({x}) * abs({x}) / 600 * list_sum(list_transform(range(201), lambda k: CASE WHEN k IN (0, 200) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow({x} * k / 200, 2) / 2))) / sqrt(2 * pi()))"
TAILS = {
    "normal": NORMAL_TAIL.format(x=Z),
    "lognormal": f"CASE WHEN {Z} > 0 THEN {NORMAL_TAIL.format(x=f'ln(CASE WHEN {Z} > 0 THEN {Z} ELSE 1 END)')} ELSE 1 END",
    "gamma": f"CASE WHEN {Z} > 0 THEN exp(-{Z}) * (1 + {Z} + {Z} * {Z} / 2) ELSE 1 END",
    "chi2": f"CASE WHEN {Z} > 0 THEN exp(-{Z} / 2) * (1 + {Z} / 2) ELSE 1 END",
    "beta": f"CASE WHEN {Z} <= 0 THEN 1 WHEN {Z} >= 1 THEN 0 ELSE 1 - 6 * pow({Z}, 2) + 8 * pow({Z}, 3) - 3 * pow({Z}, 4) END",
    "student_t": f"0.5 - ({Z} / sqrt(3) / (1 + {Z} * {Z} / 3) + atan({Z} / sqrt(3))) / pi()",
}
for name, sql in TAILS.items():
    ORACLES[f"tail_{name}"] = f"SELECT event_id, {r(sql, 'sf')} FROM events"

COUNTS = {
    "poisson": ("exp(-2.5) * pow(2.5, k) / factorial(k::INT)::DOUBLE", "list_sum(list_transform(range(k + 1), lambda j: exp(-2.5) * pow(2.5, j) / factorial(j::INT)::DOUBLE))"),
    "binomial": (
        "CASE WHEN k > 9 THEN 0 ELSE factorial(9)::DOUBLE / factorial(k::INT)::DOUBLE / factorial(greatest(9 - k, 0)::INT)::DOUBLE * pow(0.3, k) * pow(0.7, 9 - k) END",
        "CASE WHEN k > 9 THEN 1 ELSE list_sum(list_transform(range(least(k, 9) + 1), lambda j: factorial(9)::DOUBLE / factorial(j::INT)::DOUBLE / factorial((9 - j)::INT)::DOUBLE * pow(0.3, j) * pow(0.7, 9 - j))) END",
    ),
    "geometric": ("CASE WHEN k < 1 THEN 0 ELSE 0.4 * pow(0.6, k - 1) END", "CASE WHEN k < 1 THEN 0 ELSE 1 - pow(0.6, k) END"),
    "discrete_uniform": ("CASE WHEN k BETWEEN 2 AND 5 THEN 0.25 ELSE 0 END", "greatest(0, least(1, (k - 1) / 4))"),
    "bernoulli": ("CASE k WHEN 0 THEN 0.7 WHEN 1 THEN 0.3 ELSE 0 END", "CASE k WHEN 0 THEN 0.7 ELSE 1 END"),
}
for name, (pmf, cdf) in COUNTS.items():
    ORACLES[f"counts_{name}"] = f"SELECT event_id, round(({pmf})::DOUBLE, 4) + 0.0 AS pmf, round(({cdf})::DOUBLE, 4) + 0.0 AS cdf FROM (SELECT event_id, event_id % 12 AS k FROM events)"

CHOOSE = "(factorial({n}::INT)::DOUBLE / factorial(({k})::INT)::DOUBLE / factorial(({n} - ({k}))::INT)::DOUBLE)"
MORE_COUNTS = [
    (D.negative_binomial(3, 0.4), "(k + 2) * (k + 1) / 2 * pow(0.4, 3) * pow(0.6, k)", "list_sum(list_transform(range(k + 1), lambda j: (j + 2) * (j + 1) / 2 * pow(0.4, 3) * pow(0.6, j)))"),
    (
        D.hypergeometric(20, 8, 6),
        f"CASE WHEN k > 6 THEN 0 ELSE {CHOOSE.format(n=8, k='least(k, 6)')} * {CHOOSE.format(n=12, k='6 - least(k, 6)')} / {CHOOSE.format(n=20, k=6)} END",
        f"list_sum(list_transform(range(least(k, 6) + 1), lambda j: {CHOOSE.format(n=8, k='j')} * {CHOOSE.format(n=12, k='6 - j')} / {CHOOSE.format(n=20, k=6)}))",
    ),
]
for dist, pmf, cdf in MORE_COUNTS:

    @query(f"counts_{dist.name}", f"SELECT event_id, round(({pmf})::DOUBLE, 4) + 0.0 AS pmf, round(({cdf})::DOUBLE, 4) + 0.0 AS cdf FROM (SELECT event_id, event_id % 12 AS k FROM events)")
    def _(spark, d, dist=dist):
        k = (F.col("event_id") % 12).cast("double")
        return events(spark, d).select("event_id", dist.pdf(k).alias("pmf"), dist.cdf(k).alias("cdf"))


#: F with 4 and 2 degrees: tail 1 - (2 z / (1 + 2 z))**2 by its own integral; inverse gamma of shape 2: tail 1 - (1 + 1/z) exp(-1/z).
MORE_DENSITIES = [
    (D.f_distribution(4, 2), f"CASE WHEN {Z} > 0 THEN 8 * {Z} / pow(1 + 2 * {Z}, 3) ELSE 0 END", f"CASE WHEN {Z} > 0 THEN 1 - pow(2 * {Z} / (1 + 2 * {Z}), 2) ELSE 1 END"),
    (D.inverse_gamma(2.0), f"CASE WHEN {Z} > 0 THEN exp(-1 / CASE WHEN {Z} > 0 THEN {Z} ELSE 1 END) / pow({Z}, 3) ELSE 0 END", f"CASE WHEN {Z} > 0 THEN 1 - (1 + 1 / CASE WHEN {Z} > 0 THEN {Z} ELSE 1 END) * exp(-1 / CASE WHEN {Z} > 0 THEN {Z} ELSE 1 END) ELSE 1 END"),
    (
        D.truncated_normal(-1.0, 2.0),
        f"CASE WHEN {Z} BETWEEN -1 AND 2 THEN exp(-{Z} * {Z} / 2) / sqrt(2 * pi()) / ({NORMAL_TAIL.format(x='(-1.0)')} - {NORMAL_TAIL.format(x='2.0')}) ELSE 0 END",
        f"({NORMAL_TAIL.format(x=f'greatest(-1, least(2, {Z}))')} - {NORMAL_TAIL.format(x='2.0')}) / ({NORMAL_TAIL.format(x='(-1.0)')} - {NORMAL_TAIL.format(x='2.0')})",
    ),
]
for dist, pdf, sf in MORE_DENSITIES:

    @query(f"density_{dist.name}", f"SELECT event_id, {r(pdf, 'pdf')} FROM events")
    def _(spark, d, dist=dist):
        return events(spark, d).select("event_id", dist.pdf((F.col("value") - 50) / 25).alias("pdf"))

    @query(f"tail_{dist.name}", f"SELECT event_id, {r(sf, 'sf')} FROM events")
    def _(spark, d, dist=dist):
        return events(spark, d).select("event_id", dist.sf((F.col("value") - 50) / 25).alias("sf"))


# --- the rest --------------------------------------------------------------------------------

I0 = "(1 + list_sum(list_transform(range(1, 60), lambda m: CASE WHEN {x} > 0 THEN exp(2 * m * ln(CASE WHEN {x} > 0 THEN {x} ELSE 1 END / 2) - 2 * lgamma(m + 1)) ELSE 0 END)))"
ORACLES["kaiser_window"] = "SELECT i::INT AS i, " + r(I0.format(x="(8.6 * sqrt(greatest(0, 1 - pow((i - 31.5) / 31.5, 2))))") + " / " + I0.format(x="8.6"), "w") + " FROM range(64) t(i)"
ORACLES["differential_entropy"] = f"""WITH g AS (SELECT event_type, lead(value, 3) OVER (PARTITION BY event_type ORDER BY value) - value AS g FROM events),
m AS (SELECT event_type, avg(ln(greatest(g, 1e-300))) AS m, count(*) AS n FROM g GROUP BY 1)
SELECT event_type, {r('m + list_sum(list_transform(range(3, n), lambda j: 1.0 / j))', 'differential_entropy')} FROM m"""
ORACLES["normaltest_p"] = f"""WITH m AS (SELECT user_id, count(value)::DOUBLE AS n, avg(value) AS mean FROM events GROUP BY 1),
c AS (SELECT m.user_id, any_value(n) AS n, avg(pow(value - mean, 2)) AS m2, avg(pow(value - mean, 3)) AS m3, avg(pow(value - mean, 4)) AS m4 FROM events e JOIN m ON m.user_id = e.user_id GROUP BY 1),
g AS (SELECT user_id, n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM c),
w AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y FROM g WHERE n >= 20),
z AS (SELECT user_id, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS z2 FROM w)
SELECT m.user_id, {r('z1 * z1 + z2 * z2', 'statistic')}, {r('exp(-(z1 * z1 + z2 * z2) / 2)', 'p_value')} FROM m LEFT JOIN z ON z.user_id = m.user_id"""
ORACLES["bspline"] = f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('CASE WHEN t < 0.5 THEN 4 * t - 6 * t * t + 4 * t * t ELSE 2 * (1 - t) * (1 - t) + 2 * (4 * (1 - t) - 6 * (1 - t) * (1 - t)) + 4 * pow(2 * t - 1, 2) END', 'x')} FROM p"""
ORACLES["rotation_euler_matrix"] = f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b, l_quantity / 50 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('cos(b) * cos(c)', 'm00')}, {r('cos(b) * sin(c)', 'm10')}, {r('-sin(b)', 'm20')} FROM p"""


# A turn about an axis goes through matrix and inverse and comes back as the opposite turn.
@query("rotation_conversions", f"SELECT l_orderkey, l_linenumber, {r('-0.6 * (l_tax + 0.1)', 'x')}, {r('0.0::DOUBLE', 'y')}, {r('-0.8 * (l_tax + 0.1)', 'z')} FROM lineitem")
def _(spark, d):
    q = V.quat_from_axis_angle(F.lit(0.6), F.lit(0.0), F.lit(0.8), F.col("l_tax") + 0.1)
    back = V.quat_to_rotvec(V.quat_inverse(V.quat_from_matrix(V.quat_to_matrix(q))))
    return items(spark, d).select("l_orderkey", "l_linenumber", back.alias("v")).select("l_orderkey", "l_linenumber", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.col("v")[2].alias("z"))


def _lloyd_sql(steps: int) -> str:
    """Lloyd's iterations unrolled, from the first four vectors."""
    parts = [
        "WITH e AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), l AS MATERIALIZED (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM e)",
        "c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS label, v FROM e ORDER BY id LIMIT 4)",
    ]
    for k in range(steps + 1):
        dist = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{k} AS MATERIALIZED (SELECT id, label FROM (SELECT e.id, c.label, row_number() OVER (PARTITION BY e.id ORDER BY {dist}, c.label) AS k FROM e, c{k} c) WHERE k = 1)")
        if k < steps:
            new = f"(SELECT label, list(m ORDER BY j) AS v FROM (SELECT label, j, avg(x) AS m FROM l JOIN a{k} a ON a.id = l.id GROUP BY 1, 2) GROUP BY 1)"
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.label, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN {new} m ON m.label = c{k}.label)")
    return ", ".join(parts) + f" SELECT id, label FROM a{steps}"


ORACLES["kmeans"] = _lloyd_sql(10)


@query(
    "waverec",
    f"WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, value FROM events) SELECT user_id, pos, {r('value', 'value')} FROM s",
)
def _(spark, d):
    """The Haar transform and back: the series, one place on."""
    out = S.waverec(S.wavedec(lines(spark, d), "value", "event_id", "user_id", extension="zero"), "user_id", extension="zero")
    sizes = events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return out.join(sizes, "user_id").where("pos >= 1 AND pos <= n").select("user_id", "pos", "value")
