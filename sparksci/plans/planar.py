"""Triangulations and Voronoi diagrams of the embeddings' first two components.

The SQL takes the definition edge by edge: of all points to the left of (a, b), the one whose circle through a and b reaches
least far makes a triangle, if no point to the right lies in that circle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.operators import delaunay as D
from sparksci.plans.registry import query, r
from sparksci.sources.tables import table


def flat(spark, d, first=0):
    at = table(spark, d, "embeddings")
    return at.select(F.col("vec_id").alias("id"), F.col("embedding")[first].cast("double").alias("x"), F.col("embedding")[first + 1].cast("double").alias("y"))


TRI = """WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
s AS (SELECT a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, c.x AS cx, c.y AS cy,
  (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS side, (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) AS dot
  FROM p a JOIN p b ON a.id < b.id JOIN p c ON c.id <> a.id AND c.id <> b.id),
e AS (SELECT a, b, max(CASE WHEN side < 0 THEN dot / side END) AS bound, min(CASE WHEN side > 0 THEN dot / side END) AS near,
  arg_min(c, CASE WHEN side > 0 THEN dot / side END) AS l, arg_max(c, CASE WHEN side < 0 THEN dot / side END) AS m FROM s GROUP BY a, b),
h AS (SELECT a, b, l, m FROM e WHERE bound IS NULL OR near IS NULL OR bound <= near),
g AS (SELECT a, b, l AS c FROM h WHERE l IS NOT NULL UNION ALL SELECT a, m, b FROM h WHERE m IS NOT NULL),
f AS (SELECT DISTINCT CASE WHEN a < b AND a < c THEN a WHEN b < c THEN b ELSE c END AS a, CASE WHEN a < b AND a < c THEN b WHEN b < c THEN c ELSE a END AS b,
  CASE WHEN a < b AND a < c THEN c WHEN b < c THEN a ELSE b END AS c FROM g),
t AS (SELECT f.*, a.x AS ax, a.y AS ay, b.x - a.x AS ux, b.y - a.y AS uy, c.x - a.x AS wx, c.y - a.y AS wy FROM f JOIN p a ON a.id = f.a JOIN p b ON b.id = f.b JOIN p c ON c.id = f.c),
v AS (SELECT a, b, c, ax, ay, ax + (wy * (ux * ux + uy * uy) - uy * (wx * wx + wy * wy)) / (2 * (ux * wy - uy * wx)) AS vx,
  ay + (ux * (wx * wx + wy * wy) - wx * (ux * ux + uy * uy)) / (2 * (ux * wy - uy * wx)) AS vy FROM t),
n AS (SELECT a AS u, b AS v FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f) """


@query("delaunay", TRI + "SELECT a, b, c FROM f")
def _(spark, d):
    return D.delaunay(flat(spark, d)).select("a", "b", "c")


@query("delaunay_vertex_neighbors", TRI + "SELECT u AS id, v AS neighbor FROM n UNION SELECT v, u FROM n")
def _(spark, d):
    return D.vertex_neighbors(D.delaunay(flat(spark, d)))


@query("delaunay_hull", TRI + "SELECT u, v FROM n WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.u = n.v AND o.v = n.u)")
def _(spark, d):
    return D.hull_edges(D.delaunay(flat(spark, d)))


@query(
    "delaunay_find_simplex",
    TRI
    + """, q AS (SELECT vec_id AS id, embedding[3]::DOUBLE AS x, embedding[4]::DOUBLE AS y FROM embeddings),
k AS (SELECT q.id, t.a, t.b, t.c FROM q JOIN t ON ux * (q.y - ay) - uy * (q.x - ax) >= 0 AND wy * (q.x - ax) - wx * (q.y - ay) >= 0
  AND (wx - ux) * (q.y - ay - uy) - (wy - uy) * (q.x - ax - ux) >= 0) SELECT q.id, a, b, c FROM q LEFT JOIN k USING (id)""",
)
def _(spark, d):
    """The third and fourth components are asked for in the triangulation of the first two."""
    return D.find_simplex(flat(spark, d), flat(spark, d, 2))


@query(
    "voronoi_ridges",
    TRI
    + """, s2 AS (SELECT n.u, n.v, f.a, f.b, f.c FROM n JOIN f ON (n.u = f.a AND n.v = f.b) OR (n.u = f.b AND n.v = f.c) OR (n.u = f.c AND n.v = f.a))
SELECT least(u, v) AS i, greatest(u, v) AS j, count(*) = 1 AS is_ray, """
    + r("CASE WHEN count(*) = 2 THEN ln(sqrt((max(vx) - min(vx)) ** 2 + (max(vy) - min(vy)) ** 2)) END", "log_length")
    + " FROM s2 JOIN v USING (a, b, c) GROUP BY 1, 2",
)
def _(spark, d):
    ridges = D.voronoi_ridges(D.delaunay(flat(spark, d)))
    return ridges.select("i", "j", F.col("x2").isNull().alias("is_ray"), F.log(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))).alias("log_length"))


@query(
    "voronoi_regions",
    TRI
    + """, w AS (SELECT a AS id, vx, vy FROM v UNION ALL SELECT b, vx, vy FROM v UNION ALL SELECT c, vx, vy FROM v),
d AS (SELECT w.id, w.vx - p.x AS dx, w.vy - p.y AS dy FROM w JOIN p USING (id)),
o AS (SELECT id, dx, dy, coalesce(lead(dx) OVER k, first_value(dx) OVER k) AS ex, coalesce(lead(dy) OVER k, first_value(dy) OVER k) AS ey FROM d WINDOW k AS (PARTITION BY id ORDER BY atan2(dy, dx))),
z AS (SELECT id, count(*) AS n_vertices, sum(dx * ey - dy * ex) / 2 AS area FROM o GROUP BY id),
m AS (SELECT u AS id, count(*) AS n_neighbors FROM (SELECT u, v FROM n UNION SELECT v, u FROM n) GROUP BY u)
SELECT id, n_vertices, n_neighbors, n_neighbors = n_vertices AS bounded, """
    + r("CASE WHEN n_neighbors = n_vertices THEN ln(area) END", "log_area")
    + " FROM z JOIN m USING (id)",
)
def _(spark, d):
    regions = D.voronoi_regions(D.delaunay(flat(spark, d)))
    return regions.select("id", "n_vertices", "n_neighbors", "bounded", F.log("area").alias("log_area"))
