"""Graph queries: suppliers and parts of lineitem; customers, nations and regions as a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.operators import graph as G
from sparksci.plans.registry import query, r
from sparksci.plans.statistics import items
from sparksci.sources import tables

PART = 1_000_000


def supply(spark, d, directed=True):
    return tables.edges(items(spark, d), F.col("l_suppkey"), F.col("l_partkey") + PART, None, directed)


E = f"WITH one AS (SELECT l_suppkey AS src, l_partkey + {PART} AS dst, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), "
DIRECTED = E + "e AS (SELECT * FROM one), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) "
BOTH = E + "e AS (SELECT * FROM one UNION ALL SELECT dst, src, w FROM one), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) "


@query("degree_centrality", BOTH + f"SELECT id, {r('coalesce(s, 0) / (SELECT count(*) - 1 FROM n)', 'centrality')} FROM n LEFT JOIN (SELECT src, sum(w) AS s FROM e GROUP BY 1) ON src = id")
def _(spark, d):
    e = supply(spark, d, False)
    return G.degree_centrality(e, G.nodes_of(e))


@query("laplacian_matrix", BOTH + f"SELECT src AS i, src AS j, {r('count(*)', 'v')} FROM e GROUP BY 1 UNION ALL SELECT src, dst, -1.0::DOUBLE FROM e")
def _(spark, d):
    e = supply(spark, d, False)
    return G.laplacian_matrix(e, G.nodes_of(e))


@query(
    "laplacian_normalized",
    BOTH + f", g AS (SELECT src AS id, count(*)::DOUBLE AS d FROM e GROUP BY 1) SELECT id AS i, id AS j, {r('1.0::DOUBLE', 'v')} FROM g UNION ALL SELECT src, dst, {r('-1 / sqrt(a.d * b.d)')} FROM e JOIN g a ON a.id = src JOIN g b ON b.id = dst",
)
def _(spark, d):
    e = supply(spark, d, False)
    return G.laplacian_matrix(e, G.nodes_of(e), True)


@query("adjacency_matrix", DIRECTED + "SELECT src, dst, w FROM e")
def _(spark, d):
    return supply(spark, d)


@query("incidence_matrix", DIRECTED + "SELECT src AS node, src, dst, -1.0::DOUBLE AS v FROM e UNION ALL SELECT dst, src, dst, 1.0::DOUBLE FROM e")
def _(spark, d):
    return G.incidence_matrix(supply(spark, d))


def _rank_sql(steps: int) -> str:
    """PageRank unrolled: one pair of CTEs an iteration."""
    parts = [BOTH.rstrip() + ", o AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for k in range(steps):
        parts.append(
            f"r{k + 1} AS (SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85 * coalesce(g, 0) AS r FROM n LEFT JOIN (SELECT dst, sum(r * w / t) AS g FROM e JOIN o ON o.src = e.src JOIN r{k} x ON x.id = e.src GROUP BY 1) ON dst = n.id)"
        )
    return ", ".join(parts) + f" SELECT id, round(r * 1000, 4) + 0.0 AS rank FROM r{steps}"


@query("pagerank", _rank_sql(20))
def _(spark, d):
    e = supply(spark, d, False)
    return G.pagerank(e, G.nodes_of(e), max_iter=20, tol=0.0).select("id", (F.col("rank") * 1000).alias("rank"))


@query("eigenvector_centrality")
def _(spark, d):
    e = supply(spark, d, False)
    return G.eigenvector_centrality(e, G.nodes_of(e), tol=1e-10)


def sparse(spark, d):
    """Customers linked to their orders: many stars."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + PART).alias("dst"), F.lit(1.0).alias("w"))


EVERY = f"WITH e AS (SELECT o_custkey AS src, o_orderkey + {PART} AS dst FROM orders) "


@query("connected_components", EVERY + "SELECT src AS id, src AS component FROM e UNION SELECT dst, src FROM e")
@query("connected_components_all", EVERY + "SELECT src AS id, src AS component FROM e UNION SELECT dst, src FROM e")
def _(spark, d):
    e = sparse(spark, d)
    return G.connected_components(e, G.nodes_of(e))


def tree(spark, d):
    """Region to nation to customer, weighted."""
    nation, customer = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "customer"))
    up = nation.select((F.col("n_regionkey") + 10_000_000).alias("src"), (F.col("n_nationkey") + 20_000_000).alias("dst"), (F.col("n_nationkey") % 3 + 1).alias("w"))
    down = customer.select((F.col("c_nationkey") + 20_000_000).alias("src"), F.col("c_custkey").alias("dst"), (F.col("c_custkey") % 7 + 1).alias("w"))
    return up.union(down).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double"))


TREE = """WITH e AS (SELECT (n_regionkey + 10000000)::BIGINT AS src, (n_nationkey + 20000000)::BIGINT AS dst, (n_nationkey % 3 + 1)::DOUBLE AS w FROM nation
UNION ALL SELECT (c_nationkey + 20000000)::BIGINT, c_custkey::BIGINT, (c_custkey % 7 + 1)::DOUBLE FROM customer) """


@query(
    "shortest_paths",
    TREE
    + """SELECT 10000000::BIGINT AS source, 10000000::BIGINT AS id, 0.0::DOUBLE AS distance, -1::BIGINT AS predecessor UNION ALL SELECT src, dst, w, src FROM e WHERE src = 10000000
UNION ALL SELECT a.src, b.dst, a.w + b.w, b.src FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 10000000""",
)
def _(spark, d):
    return G.shortest_paths(tree(spark, d), spark.range(10_000_000, 10_000_001))


@query("minimum_spanning_tree", TREE + "SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w FROM e")
def _(spark, d):
    e = tree(spark, d)
    e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return G.minimum_spanning_tree(e, G.nodes_of(e))


@query("strongly_connected_components", TREE + "SELECT src AS id, src AS component FROM e UNION SELECT dst, dst FROM e")
def _(spark, d):
    e = tree(spark, d)
    return G.strongly_connected_components(e, G.nodes_of(e))


@query("closeness_centrality")
def _(spark, d):
    e = tree(spark, d)
    return G.closeness_centrality(e, G.nodes_of(e))
