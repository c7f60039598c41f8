"""Distance and neighbour queries over embeddings, and rotations over lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.functions import vectors as V
from sparksci.operators import spatial as S
from sparksci.plans.registry import query, r
from sparksci.plans.statistics import items
from sparksci.sources.tables import points, table


def embedded(spark, d):
    return points(table(spark, d, "embeddings"), "vec_id", "embedding")


def asked(spark, d):
    """The stated query set: every fiftieth vector."""
    return embedded(spark, d).where(F.col("id") % 50 == 0)


P = """WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), d AS (SELECT q.id AS query_id, e.id, {metric} AS distance
FROM e q JOIN e ON q.id % 50 = 0) """
EUCLID = "sqrt(list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
METRICS = {
    "euclidean": EUCLID,
    "sqeuclidean": "list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "manhattan": "list_sum(list_transform(list_zip(q.v, e.v), lambda p: abs(p[1] - p[2])))",
    "cosine": "1 - list_sum(list_transform(list_zip(q.v, e.v), lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(q.v, lambda x: x * x)) * list_sum(list_transform(e.v, lambda x: x * x)))",
}
for name, sql in METRICS.items():

    @query(f"cdist_{name}", P.format(metric=sql) + f"SELECT query_id, id, {r('distance', 'distance')} FROM d")
    def _(spark, d, name=name):
        return S.cdist(embedded(spark, d), asked(spark, d), name)


VECTORS = "WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) "
PAIRS = VECTORS + f"SELECT q.id AS i, e.id AS j, {r(EUCLID, 'distance')} FROM e q JOIN e ON q.id < e.id"
SQUARE = VECTORS + f"SELECT q.id AS i, e.id AS j, {r(f'CASE WHEN q.id = e.id THEN 0.0 ELSE {EUCLID} END', 'distance')} FROM e q, e"


@query("pdist_all", PAIRS)  # the older name of the same query
@query("pdist", PAIRS)
def _(spark, d):
    return S.pdist(embedded(spark, d))


@query("squareform_all", SQUARE)  # the older name of the same query
@query("squareform", SQUARE)
def _(spark, d):
    e = embedded(spark, d)
    return S.squareform(S.pdist(e), e.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())))


@query(
    "knn",
    P.format(metric=EUCLID) + f", k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) SELECT query_id, rank::INT AS rank, id, {r('distance', 'distance')} FROM k WHERE rank <= 10",
)
def _(spark, d):
    return S.knn(embedded(spark, d), asked(spark, d), 10)


@query("radius_join", P.format(metric=EUCLID) + f"SELECT query_id, id, {r('distance', 'distance')} FROM d WHERE distance <= 1.1")
def _(spark, d):
    return S.radius_join(embedded(spark, d), asked(spark, d), 1.1)


@query(
    "rotation_apply",
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_discount * 3 AS t, l_quantity AS x, l_tax AS y, l_linenumber::DOUBLE AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, {r('x * cos(t) - y * sin(t)', 'rx')}, {r('x * sin(t) + y * cos(t)', 'ry')}, {r('z', 'rz')} FROM a""",
)
def _(spark, d):
    q = V.quat_from_rotvec(F.lit(0.0), F.lit(0.0), F.col("l_discount") * 3)
    v = V.rotate(q, F.array("l_quantity", "l_tax", F.col("l_linenumber").cast("double")))
    return items(spark, d).select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", F.col("v")[0].alias("rx"), F.col("v")[1].alias("ry"), F.col("v")[2].alias("rz"))


@query("rotation_magnitude", f"SELECT l_orderkey, l_linenumber, {r('sqrt(l_discount * l_discount + l_tax * l_tax)', 'angle')} FROM lineitem")
def _(spark, d):
    q = V.quat_from_rotvec(F.col("l_discount"), F.col("l_tax"), F.lit(0.0))
    return items(spark, d).select("l_orderkey", "l_linenumber", V.quat_magnitude(q).alias("angle"))


@query("rotation_compose", f"SELECT l_orderkey, l_linenumber, {r('l_discount + l_tax', 'angle')} FROM lineitem")
def _(spark, d):
    z = F.lit(0.0)
    q = V.quat_multiply(V.quat_from_rotvec(z, z, F.col("l_discount")), V.quat_from_rotvec(z, z, F.col("l_tax")))
    return items(spark, d).select("l_orderkey", "l_linenumber", V.quat_magnitude(q).alias("angle"))


@query("rotation_slerp", f"SELECT l_orderkey, l_linenumber, {r('l_tax + 0.25 * l_discount', 'angle')} FROM lineitem")
def _(spark, d):
    z = F.lit(0.0)
    q = V.slerp(V.quat_from_rotvec(z, z, F.col("l_tax")), V.quat_from_rotvec(z, z, F.col("l_tax") + F.col("l_discount")), F.lit(0.25))
    return items(spark, d).select("l_orderkey", "l_linenumber", V.quat_magnitude(q).alias("angle"))


@query("rotation_euler_matrix")
def _(spark, d):
    q = V.quat_from_euler("XYZ", F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    m = V.quat_to_matrix(q)
    return items(spark, d).select("l_orderkey", "l_linenumber", m[0][0].alias("m00"), m[1][0].alias("m10"), m[2][0].alias("m20"))


@query("rotation_as_euler", f"SELECT l_orderkey, l_linenumber, {r('l_discount', 'a')}, {r('l_tax', 'b')}, {r('l_quantity / 50', 'c')} FROM lineitem")
def _(spark, d):
    q = V.quat_from_euler("XYZ", F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    return items(spark, d).select("l_orderkey", "l_linenumber", V.quat_to_euler(q).alias("e")).select("l_orderkey", "l_linenumber", "e.a", "e.b", "e.c")
