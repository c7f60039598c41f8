"""Morphology over an image of events: hours by users modulo 24, one image an event type."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators import images
from sparksci.operators import morphology as M
from sparksci.plans.registry import query, r
from sparksci.plans.statistics import events
from sparksci.sources.tables import image

IMAGE = """WITH h AS (SELECT event_type AS img, hour(ts)::INT AS y, (user_id % 24)::INT AS x, sum(value) AS v FROM events GROUP BY 1, 2, 3),
a AS (SELECT t.img, y.y::INT AS y, x.x::INT AS x, coalesce(h.v, 0) AS v FROM (SELECT DISTINCT img FROM h) t CROSS JOIN range(24) y(y) CROSS JOIN range(24) x(x)
LEFT JOIN h ON h.img = t.img AND h.y = y.y AND h.x = x.x) """


def pixels(spark, d):
    e = events(spark, d)
    return image(e, F.hour("ts"), F.col("user_id") % 24, F.col("value"), 24, 24, F.col("event_type"))


def swept(source: str, name: str, agg: str) -> str:
    near = f"SELECT a.img, a.y, a.x, {agg}(b.v) AS v FROM {source} a JOIN {source} b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3"
    return f", {name} AS ({near})"


ERODED, DILATED = swept("a", "ero", "min"), swept("a", "dil", "max")
OPENED, CLOSED = ERODED + swept("ero", "ope", "max"), DILATED + swept("dil", "clo", "min")
OUT = f"SELECT img, y, x, {r('v', 'v')} FROM "
MINUS = f"SELECT p.img, p.y, p.x, {r('p.v - q.v', 'v')} FROM {{p}} p JOIN {{q}} q ON p.img = q.img AND p.y = q.y AND p.x = q.x"

for name, sql in (
    ("grey_erosion", ERODED + OUT + "ero"),
    ("grey_dilation", DILATED + OUT + "dil"),
    ("grey_opening", OPENED + OUT + "ope"),
    ("grey_closing", CLOSED + OUT + "clo"),
    ("morphological_gradient", ERODED + DILATED + MINUS.format(p="dil", q="ero")),
    ("white_tophat", OPENED + MINUS.format(p="a", q="ope")),
    ("black_tophat", CLOSED + MINUS.format(p="clo", q="a")),
):

    @query(name, IMAGE + sql)
    def _(spark, d, name=name):
        return getattr(M, name)(pixels(spark, d))


def masked(spark, d):
    return pixels(spark, d).withColumn("v", F.when(F.col("v") > 400, 1.0).otherwise(0.0))


MASK = IMAGE + ", m AS (SELECT img, y, x, CASE WHEN v > 400 THEN 1.0 ELSE 0.0 END::DOUBLE AS v FROM a) "
EDGE = "SELECT a.img, a.y, a.x, CASE WHEN count(*) = 9 THEN min(b.v) ELSE 0 END AS v FROM {s} a JOIN {s} b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3"


@query("binary_erosion", MASK + ", e AS (" + EDGE.format(s="m") + ") " + OUT + "e")
def _(spark, d):
    return M.binary_erosion(masked(spark, d))


@query("binary_dilation", MASK + swept("m", "e", "max") + " " + OUT + "e")
def _(spark, d):
    return M.binary_dilation(masked(spark, d))


@query("binary_opening", MASK + ", e AS (" + EDGE.format(s="m") + ")" + swept("e", "o", "max") + " " + OUT + "o")
def _(spark, d):
    return M.binary_opening(masked(spark, d))


@query("binary_closing", MASK + swept("m", "e", "max") + ", o AS (" + EDGE.format(s="e") + ") " + OUT + "o")
def _(spark, d):
    return M.binary_closing(masked(spark, d))


def by_number(df):
    """Images numbered from 1 in order of their names: a table of one row an image, so one window."""
    names = df.select("img").distinct().select(F.col("img").alias("name"), F.dense_rank().over(Window.orderBy("img")).cast("long").alias("number"))
    return df.join(F.broadcast(names), F.col("img") == F.col("name")).select(F.col("number").alias("img"), "y", "x", "v")


def numbered(spark, d):
    """Labels need whole numbers for images."""
    return M.label(by_number(masked(spark, d)))


@query("label")
def _(spark, d):
    return numbered(spark, d)


@query("find_objects")
def _(spark, d):
    return M.find_objects(numbered(spark, d))


@query("label_statistics")
def _(spark, d):
    return M.label_statistics(numbered(spark, d))


KERNEL = [[1.0, 2.0, 0.0], [0.5, -1.0, 3.0], [0.0, 4.0, -2.0]]
WEIGHTS = ", ".join(f"({i - 1}, {j - 1}, {c}::DOUBLE)" for i, row in enumerate(KERNEL) for j, c in enumerate(row))
REACHED = f", k AS (SELECT * FROM (VALUES {WEIGHTS}) t(dy, dx, w)) SELECT a.img, a.y, a.x, {{v}} FROM a JOIN k ON true JOIN a b ON b.img = a.img AND b.y = a.y {{sign}} k.dy AND b.x = a.x {{sign}} k.dx GROUP BY 1, 2, 3"
for name, sign in (("convolve2d", "-"), ("correlate2d", "+")):

    @query(name, IMAGE + REACHED.format(v=r("sum(k.w * b.v)", "v"), sign=sign))
    def _(spark, d, name=name):
        return getattr(images, name)(pixels(spark, d), KERNEL)


AROUND = ", s AS (SELECT a.img, a.y, a.x, any_value(a.v) AS v, list_sort(list(b.v)) AS near, avg(b.v) AS m, var_pop(b.v) AS var FROM a JOIN a b ON b.img = a.img AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3)"


@query("medfilt2d", IMAGE + AROUND + f" SELECT img, y, x, {r('near[len(near) // 2 + 1]', 'v')} FROM s")
def _(spark, d):
    return images.medfilt2d(pixels(spark, d))


@query(
    "wiener2d",
    IMAGE + AROUND + f", n AS (SELECT *, greatest(min(var) OVER (PARTITION BY img), 1e-10) AS noise FROM s) SELECT img, y, x, {r('m + CASE WHEN var > noise THEN (var - noise) / var ELSE 0 END * (v - m)', 'v')} FROM n",
)
def _(spark, d):
    return images.wiener2d(pixels(spark, d))
