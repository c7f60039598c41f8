"""Graph algorithms over edge tables (src, dst, w) and node tables (id).

Every iteration is joins and aggregates by node, written as a table in the shared
folder and cut from its lineage; nothing about all nodes or edges reaches the driver but counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.sources.tables import bucketed, forget, settled


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum of outgoing weights over n - 1."""
    n = nodes.count()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("s"))
    scale = F.lit(0.0) if n <= 1 else F.coalesce("s", F.lit(0.0)) / (n - 1)
    return nodes.join(out, "id", "left").select("id", scale.alias("centrality"))


def laplacian_matrix(edges: DataFrame, nodes: DataFrame, normalized: bool = False) -> DataFrame:
    """(i, j, v): degree (edge count) minus adjacency, or I - D^-1/2 A D^-1/2."""
    degree = nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).cast("double").alias("d"))
    if not normalized:
        return degree.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").alias("v")).union(edges.select("src", "dst", F.lit(-1.0)))
    root = degree.select("id", F.when(F.col("d") > 0, 1 / F.sqrt("d")).otherwise(0.0).alias("r"))
    off = edges.join(root.withColumnRenamed("id", "src").withColumnRenamed("r", "ri"), "src").join(root.withColumnRenamed("id", "dst").withColumnRenamed("r", "rj"), "dst")
    return degree.select(F.col("id").alias("i"), F.col("id").alias("j"), F.when(F.col("d") > 0, 1.0).otherwise(0.0).alias("v")).union(off.select("src", "dst", -F.col("ri") * F.col("rj")))


def incidence_matrix(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(node, src, dst, v): -1 at an edge's tail and +1 at its head; an undirected edge counts once."""
    rows = edges if directed else edges.where("src < dst")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(-1.0).alias("v")), F.struct(F.col("dst").alias("node"), F.lit(1.0).alias("v"))))
    return rows.select("src", "dst", ends.alias("e")).select("e.node", "src", "dst", "e.v")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Weighted PageRank; the rank of nodes without out-edges spreads evenly. Stops when ranks move less than ``tol`` in all."""
    every = settled(nodes.select("id"))
    n = every.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    # Links lie in buckets of their source, so a pass moves ranks and sums only.
    links = bucketed(edges.select("src", "dst", "w"), "src")
    out = links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("total"))
    ranks = settled(every.join(out, "id", "left").select("id", "total", F.lit(1.0 / n).alias("rank")))
    forget(every)
    loose = F.coalesce(F.sum(F.when(F.col("total").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose")
    held = ranks.agg(loose).first()["loose"]
    for _ in range(max_iter):
        shares = ranks.where("total IS NOT NULL").select(F.col("id").alias("src"), (F.col("rank") / F.col("total")).alias("share"))
        sent = links.join(shares, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("w")).alias("got"))
        base = (1 - damping) / n + damping * held / n
        new = ranks.select("id", "total", F.col("rank").alias("was")).join(sent, "id", "left").withColumn("rank", F.lit(base) + damping * F.coalesce("got", F.lit(0.0)))
        new = settled(new.select("id", "total", "rank", F.abs(F.col("rank") - F.col("was")).alias("moved")))
        held, moved = new.agg(loose, F.sum("moved").alias("moved")).first()
        forget(ranks)
        ranks = new
        if moved < tol:
            break
    forget(links)
    return ranks.select("id", "rank")


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, centrality) after ``max_iter`` passes of x <- Ax / |Ax| from equal values, or once a pass moves x by less than ``tol``.

    On a graph of two sides passes end up swinging between two vectors. Once those left could move neither by ``tol``
    in all, they are not made, and the last pass's vector is returned.
    """
    new = settled(nodes.select("id"))
    n = new.count()
    x = new.select("id", F.lit(1 / math.sqrt(max(n, 1))).alias("v"), F.lit(None).cast("double").alias("was"))
    # Links lie in buckets of their target, so a pass moves values and sums only.
    links = bucketed(edges.select("src", "dst", "w"), "dst")
    for left in range(max_iter - 1, -1, -1):
        sums = links.join(x.select(F.col("id").alias("dst"), "v"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("v")).alias("s"))
        before, new = new, settled(x.withColumnsRenamed({"was": "older", "v": "was"}).join(sums, "id", "left").select("id", "older", "was", F.coalesce("s", F.lit(0.0)).alias("v")))
        forget(before)
        size = math.sqrt(new.agg(F.sum(F.col("v") ** 2)).first()[0] or 0.0)
        if size == 0:
            x = new.select("id", F.lit(0.0).alias("v"))
            break
        moved, swung = new.agg(*(F.sqrt(F.sum((F.col("v") / size - F.col(c)) ** 2)) for c in ("was", "older"))).first()
        x = new.select("id", (F.col("v") / size).alias("v"), "was")
        if moved < tol:
            break
        if swung is not None and swung * max(1, left) < tol:
            x = new.select("id", F.col("was").alias("v")) if left % 2 else x
            break
    forget(links)
    return x.select("id", F.abs("v").alias("centrality"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least node id reachable, edges taken both ways.

    Labels go along edges and then jump to the label of the node that they name, so passes grow with the
    logarithm of the diameter. Labels are met by sorted exchanges: broadcasts would pass through the driver once a join.
    """
    both = bucketed(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "dst")
    labels = settled(nodes.select("id", F.col("id").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("dst"), "label").hint("merge"), "dst").groupBy("src").agg(F.min("label").alias("seen"))
        near = labels.select("id", "label").join(seen.hint("merge"), F.col("id") == F.col("src"), "left").select("id", F.col("label").alias("was"), F.least("label", "seen").alias("label"))
        goal = labels.select(F.col("id").alias("name"), F.col("label").alias("goal"))
        new = settled(near.join(goal.hint("merge"), F.col("label") == F.col("name"), "left").select("id", "was", F.least("label", "goal").alias("label")))
        done = new.where("label <> was").isEmpty()
        forget(labels)
        labels = new
        if done:
            forget(both)
            return labels.select("id", F.col("label").alias("component"))


def is_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    return connected_components(edges, nodes).select("component").distinct().limit(2).count() == 1


def strongly_connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) by colouring: labels spread forward until they settle, then each colour's root gathers backwards.

    Roots that found their component leave with it; every round settles one component a colour at least.
    """
    left, links, found = settled(nodes.select("id")), settled(edges.select("src", "dst").where("src <> dst").distinct()), None
    while not left.isEmpty():
        colour = settled(left.select("id", F.col("id").alias("c")))
        while True:
            got = links.join(colour.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = settled(colour.withColumnRenamed("c", "was").join(got, "id", "left").select("id", "was", F.least("was", "m").alias("c")))
            done = new.where("c <> was").isEmpty()
            colour = new.select("id", "c")
            if done:
                break
        within = settled(
            links.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        )
        reached = settled(colour.where("id = c"))
        while True:
            more = within.join(reached.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            fresh = settled(more.join(reached.select("id"), "id", "left_anti"))
            if fresh.isEmpty():
                break
            reached = settled(reached.unionByName(fresh))
        own = reached.select("id", F.col("c").alias("component"))
        found = own if found is None else found.unionByName(own)
        left = settled(left.join(reached.select("id"), "id", "left_anti"))
        links = settled(links.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    # A component's name is its least node.
    out = found if found is not None else nodes.select("id", F.col("id").alias("component"))
    names = out.groupBy("component").agg(F.min("id").alias("name"))
    return out.join(names, "component").select("id", F.col("name").alias("component"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_iter: int | None = None) -> DataFrame:
    """(source, id, distance, predecessor) from each source by relaxing the frontier only; unreachable nodes have no row.

    Negative weights are allowed without negative cycles; ``max_iter`` bounds the edges of a path.
    """
    known = settled(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(-1).cast("long").alias("predecessor")))
    frontier, step = known, 0
    while max_iter is None or step < max_iter:
        step += 1
        tried = frontier.select("source", F.col("id").alias("src"), F.col("distance").alias("d")).join(edges, "src")
        best = tried.groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct((F.col("d") + F.col("w")).alias("distance"), F.col("src").alias("predecessor"))).alias("n"))
        old = known.select("source", "id", F.col("distance").alias("was"), F.col("predecessor").alias("by"))
        merged = settled(
            old.join(best, ["source", "id"], "full").select(
                "source", "id",
                F.when(F.col("n").isNotNull() & (F.col("was").isNull() | (F.col("n.distance") < F.col("was"))), F.col("n")).otherwise(F.struct(F.col("was").alias("distance"), F.col("by").alias("predecessor"))).alias("r"),
                (F.col("n").isNotNull() & (F.col("was").isNull() | (F.col("n.distance") < F.col("was")))).alias("better"),
            )
        )
        known = merged.select("source", "id", "r.distance", "r.predecessor")
        frontier = merged.where("better").select("source", "id", "r.distance", "r.predecessor")
        if frontier.isEmpty():
            break
    return known


def closeness_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reachable nodes over the sum of their distances; every node is a source, as the definition demands."""
    d = shortest_paths(edges, nodes).where("source <> id").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.sum("distance").alias("s"))
    return nodes.join(d, "id", "left").select("id", F.when(F.col("s") > 0, F.col("n") / F.col("s")).otherwise(0.0).alias("centrality"))


def minimum_spanning_tree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w) with src < dst: each component takes its least edge, then components merge (a forest if unconnected)."""
    rows = settled(edges.where("src < dst").select("src", "dst", "w"))
    label, tree = settled(nodes.select("id", F.col("id").alias("c"))), None
    while True:
        ends = rows.join(label.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(label.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        rows = settled(ends)
        if rows.isEmpty():
            return tree if tree is not None else rows.select("src", "dst", "w")
        both = rows.select(F.col("cs").alias("c"), F.struct("w", "src", "dst").alias("e")).union(rows.select("cd", F.struct("w", "src", "dst")))
        chosen = settled(both.groupBy("c").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.w").distinct())
        tree = settled(chosen if tree is None else tree.unionByName(chosen))
        label = settled(connected_components(tree, nodes).select("id", F.col("component").alias("c")))
        rows = rows.select("src", "dst", "w")


#: (source, node) rows of the sources that betweenness advances together.
PAIRS = 1 << 24
#: Rounds in which betweenness folds nodes of one neighbour; what hangs on by longer ways stays among the sources.
FOLDS = 16


def betweenness_centrality(edges: DataFrame, nodes: DataFrame, directed: bool = True, normalized: bool = True) -> DataFrame:
    """Share of shortest paths (by hops) through each node: levels forwards with path counts, then dependencies backwards.

    Where all links go both ways, nodes with a single neighbour are folded into it, round by round: all paths to them
    go that way, so they count by products of sizes. A node that is left is a source, weighted by what it holds, and
    a row is a (source, node) pair, as the definition demands; sources advance in batches of about PAIRS rows, each
    with its levels written.
    """
    links = settled(edges.select("src", "dst").where("src <> dst").distinct())
    n = nodes.count()
    held, total = settled(nodes.select("id", F.lit(1.0).alias("reach"))), None
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if links.join(back, ["src", "dst"], "left_anti").isEmpty():
        links, held, total = _folded(links, held)
    left = held.count()
    batches = max(1, math.ceil(left * left / PAIRS))
    dealt = F.pmod(F.xxhash64("id"), F.lit(batches))
    for k in range(batches):
        part = settled(_dependencies(links, held.where(dealt == k), held))
        total = part if total is None else total.union(part)
    scale = (0.5 if not directed else 1.0) * (((2.0 if not directed else 1.0) / ((n - 1) * (n - 2))) if normalized and n > 2 else 1.0)
    sums = total.groupBy("id").agg(F.sum("c").alias("c"))
    return nodes.join(sums, "id", "left").select("id", (F.coalesce("c", F.lit(0.0)) * scale).alias("centrality"))


def _folded(links: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left of (src, dst) and (id, reach) without nodes of one neighbour, and (id, c): the paths that this settles.

    reach counts a node and all that was folded into it. A path between two branches folded into a node goes through it, and so
    does one from its branches to the rest of its component.
    """
    comps = connected_components(links, held)
    sizes = comps.groupBy("component").agg(F.count("*").cast("double").alias("all"))
    whole = settled(comps.join(sizes, "component").select("id", "all"))
    outside = lambda rows: rows.join(whole, "id").select("id", (2 * (F.col("reach") - 1) * (F.col("all") - F.col("reach"))).alias("c"))
    total = None
    for _ in range(FOLDS):
        one = links.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("into")).where("n = 1").select(F.col("src").alias("id"), "into")
        # Of two that have only each other, the greater goes.
        other = one.select(F.col("id").alias("o"), F.col("into").alias("o_into"))
        gone = one.join(other, (F.col("into") == F.col("o")) & (F.col("id") == F.col("o_into")), "left").where("o IS NULL OR id > o").select("id", "into")
        gone = settled(gone.join(held, "id"))
        if gone.isEmpty():
            break
        grown = gone.groupBy(F.col("into").alias("id")).agg(F.sum("reach").alias("more"), F.sum(F.col("reach") ** 2).alias("squares"))
        stays = settled(held.join(gone.select("id"), "id", "left_anti").join(grown, "id", "left"))
        between = stays.where("more IS NOT NULL").select("id", (2 * (F.col("reach") - 1) * F.col("more") + F.col("more") ** 2 - F.col("squares")).alias("c"))
        part = settled(outside(gone.select("id", "reach")).union(between))
        total = part if total is None else total.union(part)
        kept = settled(stays.select("id", (F.col("reach") + F.coalesce("more", F.lit(0.0))).alias("reach")))
        rest = settled(links.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        forget(links, held, gone, stays)
        links, held = rest, kept
    part = settled(outside(held))
    forget(whole)
    return links, held, part if total is None else total.union(part)


def _dependencies(links: DataFrame, sources: DataFrame, held: DataFrame) -> DataFrame:
    """(id, c): the dependencies of the sources on each node, added up; sources and targets count by the reach that ``held`` gives them."""
    level = settled(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))
    known, levels = level.select("source", "id"), [level]
    while True:
        ahead = level.join(links, level["id"] == links["src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = settled(ahead.join(known, ["source", "id"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        known = settled(known.union(level.select("source", "id")))
    later, total = None, None
    for level in reversed(levels):
        own = level.withColumn("dep", F.lit(0.0))
        if later is not None:
            onward = later.join(held, "id").select("source", F.col("id").alias("dst"), F.col("paths").alias("p2"), (F.col("reach") + F.col("dep")).alias("d2"))
            met = level.join(links, level["id"] == links["src"]).join(onward, ["source", "dst"])
            gained = met.groupBy("source", "id").agg(F.sum(F.col("paths") / F.col("p2") * F.col("d2")).alias("g"))
            own = level.join(gained, ["source", "id"], "left").select("source", "id", "paths", F.coalesce("g", F.lit(0.0)).alias("dep"))
        later = settled(own)
        weight = held.select(F.col("id").alias("source"), F.col("reach").alias("times"))
        part = later.where("source <> id").join(weight, "source").groupBy("id").agg(F.sum(F.col("times") * F.col("dep")).alias("c"))
        total = part if total is None else total.union(part)
    return total.groupBy("id").agg(F.sum("c").alias("c"))


def is_strongly_connected(edges: DataFrame, nodes: DataFrame) -> bool:
    return strongly_connected_components(edges, nodes).select("component").distinct().limit(2).count() == 1
