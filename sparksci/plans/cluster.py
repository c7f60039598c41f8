"""Clustering of embeddings and quality measures of their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.operators import cluster as C
from sparksci.operators import density as D
from sparksci.operators import spectral
from sparksci.plans.registry import query, r
from sparksci.plans.spatial import embedded
from sparksci.sources.tables import table

LABELLED = """WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) """
DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
LONG = LABELLED + ", l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM e), c AS (SELECT label, dim, avg(x) AS c, count(*) AS n, var_pop(x) * count(*) AS ss FROM l GROUP BY 1, 2) "


def labelled(spark, d):
    return embedded(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label")), "id")


def centers(spark, d, k=4):
    """The first k vectors: a stated start."""
    return [r["v"] for r in embedded(spark, d).orderBy("id").limit(k).collect()]


SILHOUETTE = (
    LABELLED
    + f""", p AS (SELECT a.id, a.label, b.label AS other, sum({DIST}) AS d, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN label = other THEN CASE WHEN n > 1 THEN d / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN label <> other THEN d / n END) AS b FROM p GROUP BY 1) """
)


@query("silhouette_samples", SILHOUETTE + f"SELECT id, {r('(b - a) / greatest(a, b, 1e-10)', 'silhouette')} FROM s")
def _(spark, d):
    return C.silhouette_samples(labelled(spark, d)).select("id", "silhouette")


@query("silhouette_score", SILHOUETTE + f"SELECT {r('avg((b - a) / greatest(a, b, 1e-10))', 'silhouette')} FROM s")
def _(spark, d):
    return C.silhouette_score(labelled(spark, d))


@query(
    "calinski_harabasz_score",
    LONG
    + f""", m AS (SELECT dim, sum(c * n) / sum(n) AS m FROM c GROUP BY 1)
SELECT {r('(sum(n * pow(c - m, 2)) / max(label)) / (sum(ss) / (sum(CASE WHEN c.dim = 1 THEN n END) - max(label) - 1))', 'score')} FROM c JOIN m ON c.dim = m.dim""",
)
def _(spark, d):
    return C.calinski_harabasz_score(labelled(spark, d))


@query(
    "davies_bouldin_score",
    LONG
    + f""", k AS (SELECT label, list(c ORDER BY dim) AS v FROM c GROUP BY 1), s AS (SELECT b.label, avg({DIST}) AS s FROM e a JOIN k b ON a.label = b.label GROUP BY 1),
w AS (SELECT a.label, max((sa.s + sb.s) / {DIST}) AS w FROM k a JOIN k b ON a.label <> b.label JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = b.label GROUP BY 1)
SELECT {r('avg(w)', 'score')} FROM w""",
)
def _(spark, d):
    return C.davies_bouldin_score(labelled(spark, d))


TABLE = "WITH t AS (SELECT quality AS a, toxic AS b, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), "


@query(
    "adjusted_rand_score",
    TABLE
    + f"""x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY b)),
s AS (SELECT sum(n * (n - 1) / 2) AS v, sum(n) AS t FROM t)
SELECT {r('(s.v - x.v * y.v / (t * (t - 1) / 2)) / ((x.v + y.v) / 2 - x.v * y.v / (t * (t - 1) / 2))', 'score')} FROM s, x, y""",
)
def _(spark, d):
    return C.adjusted_rand_score(table(spark, d, "labels"), "quality", "toxic")


INFO = (
    TABLE
    + """p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY a) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS pb FROM t),
e AS (SELECT sum(-p * ln(pa)) AS ha, sum(-p * ln(pb)) AS hb, sum(p * ln(p / (pa * pb))) AS mi FROM p) """
)


@query("normalized_mutual_info_score", INFO + f"SELECT {r('2 * mi / greatest(ha + hb, 1e-15)', 'score')} FROM e")
def _(spark, d):
    return C.normalized_mutual_info_score(table(spark, d, "labels"), "quality", "toxic")


@query("homogeneity_completeness_v_measure", INFO + f"SELECT {r('mi / ha', 'homogeneity')}, {r('mi / hb', 'completeness')}, {r('2 * (mi / ha) * (mi / hb) / greatest(mi / ha + mi / hb, 1e-15)', 'v_measure')} FROM e")
def _(spark, d):
    return C.homogeneity_completeness_v_measure(table(spark, d, "labels"), "quality", "toxic")


@query(
    "kmeans_predict",
    LABELLED
    + f""", c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::BIGINT AS label, v FROM e ORDER BY id LIMIT 4)
SELECT id, label FROM (SELECT a.id, b.label, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.label) AS k FROM e a, c b) WHERE k = 1""",
)
def _(spark, d):
    return C.kmeans_predict(embedded(spark, d), centers(spark, d))


@query("kmeans")
def _(spark, d):
    fitted, _, _ = C.kmeans(embedded(spark, d), centers(spark, d), max_iter=10)
    return C.kmeans_predict(embedded(spark, d), fitted)


DENSE = (
    LABELLED
    + f""", p AS (SELECT a.id AS s, b.id AS d FROM e a, e b WHERE {DIST} <= 1.0), c AS (SELECT s FROM p GROUP BY 1 HAVING count(*) >= 5),
k AS (SELECT s, d FROM p WHERE s IN (SELECT s FROM c) OR d IN (SELECT s FROM c)),
w AS (WITH RECURSIVE r(s, root) AS (SELECT DISTINCT s, s FROM k UNION SELECT k.d, r.root FROM r JOIN k ON k.s = r.s) SELECT s, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM w))
SELECT e.id, coalesce(n.label, -1)::BIGINT AS label FROM e LEFT JOIN w ON w.s = e.id LEFT JOIN n ON n.root = w.root"""
)


@query("dbscan_all", DENSE)  # the older name of the same query
@query("dbscan", DENSE)
def _(spark, d):
    return C.dbscan(embedded(spark, d), 1.0, 5)


def banked(spark, d):
    """Suppliers in the plane: nation and balance."""
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("long").alias("id"), F.array(F.col("s_nationkey") * 2.0, F.col("s_acctbal") / 1000).alias("v"))


# Within a nation, balances at most 0.4 apart: runs of neighbours are found by gaps, borders by distance.
@query(
    "dbscan_suppliers",
    """WITH e AS (SELECT s_suppkey::BIGINT AS id, s_nationkey AS n, s_acctbal / 1000 AS x FROM supplier),
p AS (SELECT a.id AS s, b.id AS d FROM e a JOIN e b ON b.n = a.n AND abs(a.x - b.x) <= 0.4), c AS (SELECT s FROM p GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT s, d FROM p WHERE s IN (SELECT s FROM c) OR d IN (SELECT s FROM c)),
w AS (WITH RECURSIVE r(s, root) AS (SELECT DISTINCT s, s FROM k UNION SELECT k.d, r.root FROM r JOIN k ON k.s = r.s) SELECT s, min(root) AS root FROM r GROUP BY 1),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM w))
SELECT e.id, coalesce(n.label, -1)::BIGINT AS label FROM e LEFT JOIN w ON w.s = e.id LEFT JOIN n ON n.root = w.root""",
)
def _(spark, d):
    return C.dbscan(banked(spark, d), 0.4, 3)


@query("hdbscan")
def _(spark, d):
    return D.hdbscan(embedded(spark, d), 5).select("id", "label", "probability")


@query("hdbscan_suppliers")
def _(spark, d):
    return D.hdbscan(banked(spark, d), 3).select("id", "label", "probability")


@query("density_optics")
def _(spark, d):
    return D.optics(banked(spark, d), 3, 2.0, xi=0.2)


def near_graph(spark, d):
    return spectral.neighbour_affinity(embedded(spark, d), 10)


@query(
    "spectral_affinity",
    LABELLED
    + f""", k AS (SELECT a.id AS i, b.id AS j, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rank FROM e a JOIN e b ON a.id <> b.id)
SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT i AS src, j AS dst FROM k WHERE rank <= 10 UNION SELECT j, i FROM k WHERE rank <= 10 UNION SELECT id, id FROM e)""",
)
def _(spark, d):
    return near_graph(spark, d)


@query("spectral_clustering")
def _(spark, d):
    return spectral.spectral_clustering(near_graph(spark, d), 4)
