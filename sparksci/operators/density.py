"""Clusters by density without a radius: mutual-reachability trees, merge trees, hdbscan and optics.

The spanning tree of the mutual reachability max(core(i), core(j), d(i, j)) grows in
Boruvka rounds: candidates from the nearest neighbours bound each component's shortest
way out, and only pairs of blocks within that bound are searched.  The tree's edges in
order of length are the merges of single linkage.  Ranges of these merges are solved
apart (a range sees what lies below it as contracted nodes), so no task holds the whole
tree; chains in it are followed by pointer doubling, in rounds that grow with the
logarithm of their length.  What has no more than MERGES rows one task follows to the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators import graph
from sparksci.operators.neighbours import Bounds, block_pairs, build, knn, meet
from sparksci.operators.statistics import ranks
from sparksci.sources.tables import forget, stored

#: Merges, or rows of pointers, that one task takes; a longer tree is halved by length until its ranges are no longer.
MERGES = 1 << 18
#: Distances below this count as this, so that densities stay finite.
LEAST = 1e-10
OUT = "comp long, w double, src long, dst long"


def core_distances(points: DataFrame, min_samples: int, metric: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """(id, core) and the neighbours (query_id, id, distance): core is the distance to the min_samples-th nearest other, null if there are fewer."""
    near = stored(knn(points, points, min_samples + 1, metric))
    core = near.groupBy(F.col("query_id").alias("id")).agg(F.max(F.when(F.col("rank") == min_samples + 1, F.col("distance"))).alias("core"))
    return core, near


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(np.r_[pdf["src"].to_numpy(), pdf["dst"].to_numpy()], return_inverse=True)
    a, b, root = at[: len(pdf)], at[len(pdf) :], np.arange(len(ids))
    while (root[a] != root[b]).any():
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    return pd.DataFrame({"id": ids, "component": ids[root]})


def components(links: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """``graph.connected_components`` of n nodes joined by fewer links than these; few in one task."""
    if n > MERGES:
        return graph.connected_components(links, nodes)
    held = links.select("src", "dst").groupBy(F.lit(0).alias("all")).applyInPandas(_joined, "id long, component long")
    return nodes.join(held, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _ways_out(alone: DataFrame, blocks: DataFrame) -> DataFrame:
    """(comp, limit): an upper bound of the shortest way out of components that lie in blocks of their own, by the pivots.

    Of each cell the blocks of the least and the greatest component are enough: one of them holds another component.
    """
    it = F.struct("hi", "low", "high", "most_core")
    some = blocks.groupBy("cell").agg(F.array(F.min_by(it, "low"), F.max_by(it, "high")).alias("p")).select(F.explode("p").alias("p"))  # two rows a pivot
    met = alone.select("hi", "low", "most_core").join(F.broadcast(some), (F.col("p.low") != F.col("low")) | (F.col("p.high") != F.col("low")))
    longest = F.array_min(F.zip_with("hi", "p.hi", lambda x, y: x + y)) * (1 + 1e-9)
    return met.groupBy(F.col("low").alias("comp")).agg(F.min(F.greatest(longest, "most_core", "p.most_core")).alias("limit"))


def mutual_spanning_tree(points: DataFrame, min_samples: int, metric: str = "euclidean", held: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(src, dst, w), src < dst: the least spanning tree of mutual reachability; lengths that are equal go by src and dst.

    ``held`` is what ``core_distances`` has found already.
    """
    core, near = held or core_distances(points, min_samples, metric)
    core = stored(core.select("id", F.coalesce("core", F.lit(float("inf"))).alias("core")))
    ends = near.where("query_id <> id").select("query_id", "id", "distance")
    ends = ends.join(core.withColumnsRenamed({"id": "query_id", "core": "c1"}), "query_id").join(core.withColumnRenamed("core", "c2"), "id")
    known = stored(ends.select(F.least("query_id", "id").alias("src"), F.greatest("query_id", "id").alias("dst"), F.greatest("distance", "c1", "c2").alias("w")).distinct())
    index = build(points, metric)
    placed = index.blocks.select("block", F.posexplode("ids").alias("pos", "id"))
    label = stored(placed.join(core, "id").select("id", "block", "pos", "core", F.col("id").alias("comp")))
    forget(near, core)
    tree = None

    def outward(row) -> Iterator[pd.DataFrame]:
        mine, theirs, ids, others = (np.asarray(c) for c in (row.q_comps, row.p_comps, row.q_ids, row.p_ids))
        held = Bounds(np.stack(row.q_vs), np.stack(row.p_vs), metric)
        cores, further = np.asarray(row.q_cores)[:, None], np.asarray(row.p_cores)
        same = mine[:, None] == theirs
        names, of = np.unique(mine, return_inverse=True)
        least = np.full(len(names), np.inf)
        np.minimum.at(least, of, np.where(same, np.inf, np.maximum(np.maximum(held.high, cores), further)).min(1))
        i, j = np.nonzero(~same & (np.maximum(np.maximum(held.low, cores), further) <= least[of][:, None]))
        w = np.maximum(np.maximum(held.pairs(i, j), cores[i, 0]), further[j])
        src, dst = np.minimum(ids[i], others[j]), np.maximum(ids[i], others[j])
        order = np.lexsort((dst, src, w, of[i]))
        first = order[np.flatnonzero(np.r_[True, np.diff(of[i][order]) != 0][: len(order)])]
        yield pd.DataFrame({"comp": mine[i[first]], "w": w[first], "src": src[first], "dst": dst[first]})

    def least(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["comp", "w", "src", "dst"]).drop_duplicates("comp")

    while (parts := label.select("comp").distinct().count()) > 1:
        comp_of = label.select("id", "comp")
        left = known.join(comp_of.withColumnsRenamed({"id": "src", "comp": "cs"}), "src").join(comp_of.withColumnsRenamed({"id": "dst", "comp": "cd"}), "dst").where("cs <> cd")
        either = left.select(F.explode(F.array("cs", "cd")).alias("comp"), F.struct("w", "src", "dst").alias("e"))
        state = label.groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("pos", "comp", "core"))).alias("s"), F.min("core").alias("least_core"), F.max("core").alias("most_core"), F.min("comp").alias("low"), F.max("comp").alias("high")
        )
        state = stored(state.select("block", F.col("s.comp").alias("comps"), F.col("s.core").alias("cores"), "least_core", "most_core", "low", "high"))
        blocks = index.blocks.join(state, "block")
        sides = blocks.select("block", "ids", "vs", "comps", "cores")
        # A block of several components gives each a way out at once, so copies, whose neighbours are all within, are not sought everywhere.
        mixed = state.where("low <> high").select(F.col("block").alias("q_block"), F.col("block").alias("p_block"))
        own = meet(mixed, sides, sides, outward, OUT).select("comp", F.struct("w", "src", "dst").alias("e"))
        first = stored(either.unionByName(own).groupBy("comp").agg(F.min("e").alias("e")))
        limits = first.select("comp", F.col("e.w").alias("limit"))
        limits = limits.union(_ways_out(blocks.join(first.select(F.col("comp").alias("low")), "low", "left_anti"), blocks))
        reach = label.select("block", "comp").distinct().join(limits, "comp", "left").groupBy("block").agg(F.max(F.coalesce("limit", F.lit(float("inf")))).alias("reach"))
        reach = stored(reach)
        pairs = block_pairs(index.blocks.join(reach, "block"), index.blocks).where("q_block <> p_block")
        ends = state.select("block", "low", "high", "least_core").join(reach, "block")
        one = lambda side: ends.select(F.col("block").alias(f"{side}_block"), *(F.col(c).alias(f"{side}_{c}") for c in ("low", "high", "least_core", "reach")))
        pairs = pairs.join(one("q"), "q_block").join(one("p"), "p_block").where("NOT (q_low = q_high AND p_low = p_high AND q_low = p_low) AND p_least_core <= q_reach").select("q_block", "p_block")
        found = meet(pairs, sides, sides, outward, OUT, (index.size, index.size), least).select("comp", F.struct("w", "src", "dst").alias("e"))
        chosen = stored(found.unionByName(first).groupBy("comp").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.w").distinct())
        joined = chosen.join(comp_of.withColumnsRenamed({"id": "src", "comp": "cs"}), "src").join(comp_of.withColumnsRenamed({"id": "dst", "comp": "cd"}), "dst")
        merged = components(joined.select(F.col("cs").alias("src"), F.col("cd").alias("dst")), label.select(F.col("comp").alias("id")).distinct(), parts)
        old, label = label, stored(label.join(merged.select(F.col("id").alias("comp"), "component"), "comp").select("id", "block", "pos", "core", F.col("component").alias("comp")))
        grown = stored(chosen if tree is None else tree.unionByName(chosen))
        forget(first, state, reach, chosen, old, tree)
        tree = grown
    forget(known, label)
    index.drop()
    return tree if tree is not None else points.sparkSession.createDataFrame([], "src long, dst long, w double")


def _merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Merges of one range in order: what each joins, by the last merge of either side within the range (0: none yet)."""
    pdf = pdf.sort_values("rank")
    size = dict(zip(pdf["u"], pdf["su"], strict=True)) | dict(zip(pdf["v"], pdf["sv"], strict=True))
    up, last = {x: x for x in size}, dict.fromkeys(size, 0)
    out = []

    def find(x: int) -> int:
        root = x
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for rank, u, v, w, p, q in zip(*(pdf[c].tolist() for c in ("rank", "u", "v", "w", "p", "q")), strict=True):
        x, y = find(u), find(v)
        a, b = min(x, y), max(x, y)
        out.append((rank, w, a, last[a], size[a], b, last[b], size[b], p, q, x == a))
        up[b], last[a], size[a] = a, rank, size[a] + size[b]
    return pd.DataFrame({"part": pdf["part"].iloc[0], **{c: [o[k] for o in out] for k, c in enumerate(("rank", "w", "a", "last_a", "size_a", "b", "last_b", "size_b", "p", "q", "p_left"))}})


def merge_tree(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, w, left, right, size_left, size_right, p, q, p_left): merges of a spanning tree's edges by length; points are nodes 0 .. n - 1.

    Nodes (id, point) number the points; merge k is node n + k - 1 and joins two earlier nodes by the edge from point
    p to q, p lying in the left one or not. Ranges of MERGES
    edges are solved apart: a tree that is longer is halved again and again, the upper half sees components of
    the lower one as nodes.
    """
    n = nodes.count()
    number = nodes.select("id", "point")
    named = tree.join(number.withColumnsRenamed({"id": "src", "point": "u"}), "src").join(number.withColumnsRenamed({"id": "dst", "point": "v"}), "dst")
    edges = stored(ranks(named.select("u", "v", "w", "src", "dst"), "w", tie=("src", "dst")).select(F.lit(0).cast("long").alias("part"), "rank", "u", "v", "w", F.lit(1).cast("long").alias("su"), F.lit(1).cast("long").alias("sv"), F.col("u").alias("p"), F.col("v").alias("q")))
    levels = max(0, math.ceil(math.log2(max(1, n - 1) / MERGES)))
    for level in range(levels):
        width = MERGES << (levels - level - 1)
        edges_at = edges.withColumn("half", F.floor((F.col("rank") - 1) / width).cast("long"))
        low, high = edges_at.where("half % 2 = 0"), edges_at.where("half % 2 = 1")
        ends = edges.select("part", F.col("u").alias("x"), F.col("su").alias("size")).union(edges.select("part", "v", "sv")).distinct()
        key = lambda p, x: F.struct(F.col(p).alias("part"), F.col(x).alias("x"))
        links = low.select(key("part", "u").alias("src"), key("part", "v").alias("dst"))
        comps = graph.connected_components(links, ends.select(key("part", "x").alias("id"))).select("id.part", "id.x", F.col("component.x").alias("to"))
        comps = stored(ends.join(comps, ["part", "x"]))
        sizes = comps.groupBy("part", "to").agg(F.sum("size").alias("size"))
        to = comps.select("part", "x", "to").join(sizes, ["part", "to"])
        high = high.join(to.withColumnsRenamed({"x": "u", "to": "u2", "size": "su2"}), ["part", "u"]).join(to.withColumnsRenamed({"x": "v", "to": "v2", "size": "sv2"}), ["part", "v"])
        columns = lambda u, v, su, sv: [F.col("half").alias("part"), F.col("rank"), F.col(u).alias("u"), F.col(v).alias("v"), F.col("w"), F.col(su).alias("su"), F.col(sv).alias("sv"), F.col("p"), F.col("q")]
        old, edges = edges, stored(low.select(*columns("u", "v", "su", "sv")).unionByName(high.select(*columns("u2", "v2", "su2", "sv2"))))
        forget(old, comps)
    solved = edges.groupBy("part").applyInPandas(_merge_range, "part long, rank long, w double, a long, last_a long, size_a long, b long, last_b long, size_b long, p long, q long, p_left boolean")
    solved = stored(solved)
    forget(edges)
    # A side that has no merge in its range is the last merge of its name in an earlier range, or a point.
    ends = solved.groupBy("part", F.col("a").alias("name")).agg(F.max("rank").alias("last"))
    asked = solved.where("last_a = 0").select("part", F.col("a").alias("name")).union(solved.where("last_b = 0").select("part", "b")).distinct()
    w = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a name has a row or two a range
    both = ends.join(asked.withColumn("asked", F.lit(True)), ["part", "name"], "full").withColumn("earlier", F.max("last").over(w))
    before = both.where("asked").select("part", "name", F.coalesce(F.col("earlier") + (n - 1), F.col("name")).alias("found"))
    a, b = (before.withColumnsRenamed({"name": s, "found": f"found_{s}"}) for s in "ab")
    out = solved.join(a, ["part", "a"], "left").join(b, ["part", "b"], "left")
    side = lambda s: F.when(F.col(f"last_{s}") > 0, F.col(f"last_{s}") + (n - 1)).otherwise(F.col(f"found_{s}"))
    return out.select((F.col("rank") + (n - 1)).alias("node"), "w", side("a").alias("left"), side("b").alias("right"), F.col("size_a").alias("size_left"), F.col("size_b").alias("size_right"), "p", "q", "p_left")


def _followed(pdf: pd.DataFrame) -> pd.DataFrame:
    node, add = pdf["node"].to_numpy(), pdf["add"].to_numpy()
    order = np.argsort(node)
    up = order[np.searchsorted(node, pdf["up"].to_numpy(), sorter=order)]
    while (up[up] != up).any():
        add, up = add + add[up], up[up]
    return pd.DataFrame({"node": node, "top": node[up], "total": add})


def followed(links: DataFrame) -> DataFrame:
    """(node, top, total) of pointers (node, up, add): the end of each way, where up is the node itself and add 0, and the sum on the way."""
    state = stored(links.select("node", "up", "add"))
    if state.count() <= 2 * MERGES:
        return state.groupBy(F.lit(0).alias("all")).applyInPandas(_followed, "node long, top long, total long")
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("up").alias("ahead"), F.col("add").alias("more"))
        new = stored(state.join(ahead, F.col("up") == F.col("at")).select("node", F.col("ahead").alias("up"), (F.col("add") + F.col("more")).alias("add"), (F.col("ahead") != F.col("up")).alias("moved")))
        done = new.where("moved").isEmpty()
        forget(state)
        state = new
        if done:
            return state.select("node", F.col("up").alias("top"), F.col("add").alias("total"))


def tops(links: DataFrame) -> DataFrame:
    """(node, top) of pointers (node, up), where up is the node itself at the end of a way."""
    return followed(links.select("node", "up", F.lit(0).cast("long").alias("add"))).select("node", "top")


def condensed_tree(merges: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, parent, birth, death, stability) and members (node, cluster) of every point and merge.

    A merge of two sides of min_cluster_size is a split; a cluster is what lies below a split (or the root) down to
    the next. Its points leave it one by one at density 1 / distance; stability adds up how long they stayed, and
    death is the density at which the last ones go.
    """
    big = lambda side: F.col(f"size_{side}") >= min_cluster_size
    whole = F.col("size_left") + F.col("size_right")
    split = big("left") & big("right")
    rows = merges.select("*", split.alias("split"), whole.alias("size"), (1 / F.greatest("w", F.lit(LEAST))).alias("density"))
    child = rows.select(F.col("node").alias("parent"), "split", "density", F.explode(F.array("left", "right")).alias("node"))
    child = stored(child)
    root = rows.agg(F.max("node").alias("node")).where("node IS NOT NULL")
    links = child.select("node", F.when(F.col("split"), F.col("node")).otherwise(F.col("parent")).alias("up")).union(root.select("node", F.col("node").alias("up")))
    members = tops(links).select("node", F.col("top").alias("cluster"))
    left = F.when(split, F.col("size")).when(big("left"), F.col("size_right")).when(big("right"), F.col("size_left")).otherwise(F.col("size"))
    gone = rows.where(F.col("size") >= min_cluster_size).select("node", left.alias("gone"), "density").join(members, "node")
    born = child.where("split").select(F.col("node").alias("cluster"), "parent", F.col("density").alias("birth"))
    born = born.join(members.select(F.col("node").alias("parent"), F.col("cluster").alias("above")), "parent").select("cluster", F.col("above").alias("parent"), "birth")
    born = born.union(root.select("node", F.lit(None).cast("long"), F.lit(0.0)))
    held = gone.groupBy("cluster").agg(F.sum("gone").alias("n"), F.sum(F.col("gone") * F.col("density")).alias("s"), F.max("density").alias("death"))
    clusters = born.join(held, "cluster").select("cluster", "parent", "birth", "death", (F.col("s") - F.col("n") * F.col("birth")).alias("stability"))
    return clusters, members


def leaving(merges: DataFrame, points: DataFrame, min_cluster_size: int) -> DataFrame:
    """(point, density) at which each point leaves its lowest cluster: that of the first merge above it which holds min_cluster_size points."""
    rows = merges.select("node", (F.col("size_left") + F.col("size_right") >= min_cluster_size).alias("large"), (1 / F.greatest("w", F.lit(LEAST))).alias("density"), "left", "right")
    above = rows.select(F.col("node").alias("up"), F.explode(F.array("left", "right")).alias("node"))
    small = points.select(F.col("point").alias("node")).union(rows.where("NOT large").select("node")).join(above, "node")
    ends = tops(small.union(rows.where("large").select("node", F.col("node").alias("up"))))
    met = points.select("point").join(ends, F.col("point") == F.col("node"))
    return met.select("point", F.col("top").alias("node")).join(rows.select("node", "density"), "node").select("point", "density")


def _selected(every: bool):
    """``select_clusters`` of one table of clusters; ``every`` takes those without clusters below."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, parent = pdf["cluster"].tolist(), [None if pd.isna(x) else int(x) for x in pdf["parent"]]
        above, own = dict(zip(name, parent, strict=True)), dict(zip(name, pdf["own"].tolist(), strict=True))
        below = {c: [] for c in name}
        for c, p in above.items():
            if p is not None:
                below[p].append(c)
        order = [c for c in name if above[c] is None]
        for c in order:
            order.extend(below[c])
        total, keep, chosen = {}, {}, {}
        for c in reversed(order):
            sums = sum(total[b] for b in below[c])
            better = not below[c] or (not every and own[c] >= sums)
            total[c], keep[c] = own[c] if better else sums, better and own[c] > float("-inf")
        for c in order:
            higher = None if above[c] is None else chosen[above[c]]
            chosen[c] = higher if higher is not None else c if keep[c] else None
        stable = dict(zip(name, pdf["stability"].tolist(), strict=True))
        found = [chosen[c] for c in name]
        return pd.DataFrame({"cluster": name, "chosen": pd.array(found, "Int64"), "stability": [None if c is None else stable[c] for c in found]})

    return run


def select_clusters(clusters: DataFrame, method: str = "eom", allow_single_cluster: bool = False) -> DataFrame:
    """(cluster, chosen, stability): per cluster the chosen one that it is in, null if none.

    ``eom`` keeps a cluster unless its chosen descendants are more stable together, ``leaf`` those without clusters
    below. Few clusters are walked in one task; else rounds go from the leaves up, as many as clusters lie within each other.
    """
    if method not in ("eom", "leaf"):
        raise ValueError("method is eom or leaf")
    own = F.col("stability") if allow_single_cluster else F.when(F.col("parent").isNull(), F.lit(float("-inf"))).otherwise(F.col("stability"))
    state = stored(clusters.select("cluster", "parent", "stability", own.alias("own"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("boolean").alias("keep")))
    if state.count() <= MERGES:
        return state.groupBy(F.lit(0).alias("all")).applyInPandas(_selected(method == "leaf"), "cluster long, chosen long, stability double")
    while not state.where("total IS NULL").isEmpty():
        below = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("above")).agg(F.sum("total").alias("sum"), F.count("*").alias("n"), F.count("total").alias("known"))
        met = state.join(below, state["cluster"] == below["above"], "left")
        leaf = F.col("n").isNull()
        ready = F.col("total").isNull() & (leaf | (F.col("n") == F.col("known")))
        better = leaf | (F.lit(method == "eom") & (F.col("own") >= F.col("sum")))
        total = F.when(ready, F.when(better, F.col("own")).otherwise(F.col("sum"))).otherwise(F.col("total"))
        new = stored(met.select("cluster", "parent", "stability", "own", total.alias("total"), F.when(ready, better & (F.col("own") > float("-inf"))).otherwise(F.col("keep")).alias("keep")))
        forget(state)
        state = new
    # The highest kept cluster on the way up, by pointer doubling: what lies farther wins.
    way = stored(state.select("cluster", F.coalesce("parent", "cluster").alias("up"), F.when(F.col("keep"), F.col("cluster")).alias("kept"), F.when(F.col("parent").isNull(), True).otherwise(False).alias("end")))
    while not way.where("NOT end").isEmpty():
        ahead = way.select(F.col("cluster").alias("at"), F.col("up").alias("up2"), F.col("kept").alias("kept2"), F.col("end").alias("end2"))
        step = way.join(ahead, F.col("up") == F.col("at"))
        new = stored(step.select("cluster", F.when(F.col("end"), F.col("up")).otherwise(F.col("up2")).alias("up"), F.when(F.col("end"), F.col("kept")).otherwise(F.coalesce("kept2", "kept")).alias("kept"), (F.col("end") | F.col("end2")).alias("end")))
        forget(way)
        way = new
    stable = state.select(F.col("cluster").alias("chosen"), "stability")
    return way.select("cluster", F.col("kept").alias("chosen")).join(stable, "chosen", "left").select("cluster", "chosen", "stability")


def numbered(points: DataFrame) -> DataFrame:
    """(id, point): the points that take part, numbered from 0 in order of id."""
    usable = points.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.exists("v", lambda c: c.isNull() | F.isnan(c)))
    return ranks(usable.select(F.col("id").cast("long").alias("id")), "id").select("id", (F.col("rank") - 1).alias("point"))


def hdbscan(points: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, metric: str = "euclidean", method: str = "eom", allow_single_cluster: bool = False) -> DataFrame:
    """(id, label, probability, stability): density clusters, numbered by their least id; -1 for noise.

    Probability is how long a member stays in its cluster: the density at which it leaves, as a share of that at which
    the last ones go; 1 for those and for points of clusters below, 0 for noise. Ids are distinct; a point without vector
    is noise. Where fewer than min_samples other points exist, all are noise. A cluster holds all that lies below its
    split, also points that left it on the way down.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size is at least 2")
    every = points.select(F.col("id").cast("long").alias("id"))
    nodes = stored(numbered(points))
    k = min_cluster_size if min_samples is None else min_samples
    noise = every.select("id", F.lit(-1).cast("long").alias("label"), F.lit(0.0).alias("probability"), F.lit(None).cast("double").alias("stability"))
    n = nodes.count()
    if n <= k or n < min_cluster_size:
        return noise
    tree = stored(mutual_spanning_tree(points, k, metric))
    merges = stored(merge_tree(tree, nodes))
    clusters, members = condensed_tree(merges, min_cluster_size)
    clusters = stored(clusters)
    chosen = select_clusters(clusters, method, allow_single_cluster)
    found = nodes.join(members, nodes["point"] == members["node"]).join(chosen.where("chosen IS NOT NULL"), "cluster")
    found = found.join(clusters.select(F.col("cluster").alias("chosen"), "death"), "chosen").join(leaving(merges, nodes, min_cluster_size), "point")
    found = stored(found.select("id", "chosen", "stability", F.when(F.col("density") < F.col("death"), F.col("density") / F.col("death")).otherwise(1.0).alias("strength")))
    names = ranks(found.groupBy("chosen").agg(F.min("id").alias("least")), "least", out="label").select("chosen", (F.col("label") - 1).alias("label"))
    labels = found.join(names, "chosen").select("id", "label", "strength", "stability")
    label = F.coalesce("label", F.lit(-1)).cast("long")
    return every.join(labels, "id", "left").select("id", label.alias("label"), F.coalesce("strength", F.lit(0.0)).alias("probability"), "stability")


def _walked(edges: pd.DataFrame, roots: pd.DataFrame) -> pd.DataFrame:
    near, above = {}, dict.fromkeys(roots["point"].tolist())
    for p, q in zip(edges["p"].tolist(), edges["q"].tolist(), strict=True):
        near.setdefault(p, []).append(q)
        near.setdefault(q, []).append(p)
    open_, found = list(above), []
    while open_:
        x = open_.pop()
        for y in near.get(x, ()):
            if y != above[x]:
                above[y] = x
                open_.append(y)
                found.append((y, x))
    return pd.DataFrame(found, columns=["point", "above"]).astype("int64")


def rooted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(point, above) of a forest's edges (p, q): the neighbour on the way to the component's root (point); roots have no row.

    The edges are walked around each tree, out and back; the walk is a list that starts at the root, and pointer
    doubling counts how much of it is left at every step. An edge is walked away from the root first. Few edges are
    walked in one task.
    """
    if edges.count() <= MERGES:
        return edges.select("p", "q").groupBy(F.lit(0).alias("all")).cogroup(roots.select("point").groupBy(F.lit(0).alias("all"))).applyInPandas(_walked, "point long, above long")
    both = edges.select(F.col("p").alias("a"), F.col("q").alias("b")).union(edges.select("q", "p"))
    around = Window.partitionBy("a").orderBy("b")
    turn = both.select("a", "b", F.lead("b").over(around).alias("after"), F.first("b").over(around).alias("first"))
    # Having come from b to a, the walk goes on to a's neighbour after b; past the last one to the first, at the root it ends.
    on = turn.join(roots.select(F.col("point").alias("root"), F.lit(True).alias("is_root")), F.col("a") == F.col("root"), "left")
    step = F.when(F.col("after").isNotNull(), F.col("after")).when(F.col("is_root").isNull(), F.col("first"))
    state = stored(on.select(F.col("b").alias("x"), F.col("a").alias("y"), F.when(step.isNotNull(), F.struct(F.col("a").alias("x"), step.alias("y"))).alias("to"), F.lit(1).cast("long").alias("left")))
    while not state.where("to IS NOT NULL").isEmpty():
        ahead = state.select(F.struct("x", "y").alias("at"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        met = state.join(ahead, F.col("to") == F.col("at"), "left")
        new = stored(met.select("x", "y", F.col("to2").alias("to"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")))
        forget(state)
        state = new
    back = state.select(F.col("y").alias("x2"), F.col("x").alias("y2"), F.col("left").alias("back"))
    return state.join(back, (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))).where("left > back").select(F.col("y").alias("point"), F.col("x").alias("above"))


#: Places that a running sum takes together.
PLACES = 1 << 16


def running(df: DataFrame, place: str, value: str, out: str) -> DataFrame:
    """df with the sum of ``value`` over all rows before it; places count from 0 without gaps. No window holds more than PLACES rows of them."""
    rows = df.withColumn("__block", F.floor(F.col(place) / PLACES).cast("long"))
    sums = rows.groupBy("__block").agg(F.sum(value).alias("__s"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row in PLACES
    sums = sums.select(F.col("__block").alias("__b"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__block").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(sums, F.col("__block") == F.col("__b")).withColumn(out, F.col("__base") + F.col("__own")).drop("__block", "__b", "__base", "__own")


def optics(points: DataFrame, min_samples: int = 5, max_eps: float = float("inf"), metric: str = "euclidean", xi: float | None = None) -> DataFrame:
    """(id, place, reachability, core, label): the order in which density clusters are walked, from the least id on.

    Each next point is the one that is nearest to those before by mutual reachability, max(core(i), core(j), d(i, j)),
    ties by the ids of both; points that none before reaches within max_eps have an infinite reachability and begin
    anew from the least id left. With ``xi`` stretches from a fall by that share to the next such rise are clusters,
    numbered from 0; -1 elsewhere. Core is infinite where it is above max_eps or fewer other points exist. Points
    without vector come in no row.

    The walk along the spanning tree follows from its merges: at each merge the side that lies towards the start
    comes first, whole, then the other. So places are sums along the way up the merge tree.
    """
    nodes = stored(numbered(points))
    n = nodes.count()
    if not n:
        return points.sparkSession.createDataFrame([], "id long, place long, reachability double, core double, label long")
    core, near = core_distances(points, min_samples, metric)
    core = stored(core)
    tree = stored(mutual_spanning_tree(points, min_samples, metric, (core, near)))
    merges = stored(merge_tree(tree, nodes).where(F.col("w") <= max_eps).where(F.col("w") < float("inf")))
    comps = stored(components(merges.select(F.col("p").alias("src"), F.col("q").alias("dst")), nodes.select(F.col("point").alias("id")), n).select(F.col("id").alias("point"), "component"))
    above = stored(rooted(merges.select("p", "q"), comps.select(F.col("component").alias("point")).distinct()))
    # The end that lies away from the root is in the side that comes second.
    down = stored(merges.join(above.select(F.col("point").alias("q1"), F.col("above").alias("a1")), (F.col("q") == F.col("q1")) & (F.col("p") == F.col("a1")), "left"))
    left_first = F.col("p_left") == F.col("q1").isNotNull()
    sides = down.select("node", F.explode(F.array(
        F.struct(F.col("left").alias("child"), F.when(left_first, F.lit(0).cast("long")).otherwise(F.col("size_right")).alias("skip")),
        F.struct(F.col("right").alias("child"), F.when(left_first, F.col("size_left")).otherwise(F.lit(0).cast("long")).alias("skip")),
    )).alias("s"))
    sides = sides.select("node", "s.child", "s.skip")
    every = nodes.select(F.col("point").alias("node")).union(merges.select("node")).join(sides.select(F.col("child").alias("c"), F.col("node").alias("up"), "skip"), F.col("node") == F.col("c"), "left")
    state = followed(every.select("node", F.coalesce("up", "node").alias("up"), F.coalesce("skip", F.lit(0)).alias("add")))
    sizes = ranks(comps.groupBy("component").agg(F.count("*").alias("size")), "component", out="k").withColumn("k", F.col("k") - 1)
    begun = running(sizes, "k", "size", "begin").select("component", "begin")
    reached = down.select(F.when(F.col("q1").isNotNull(), F.col("q")).otherwise(F.col("p")).alias("reached"), "w")
    out = nodes.join(state.select(F.col("node").alias("point"), F.col("total").alias("skip")), "point").join(comps, "point").join(begun, "component")
    out = out.join(reached, F.col("point") == F.col("reached"), "left").join(core, "id", "left")
    far = F.lit(float("inf"))
    held = F.coalesce("core", far)
    out = stored(out.select("id", (F.col("begin") + F.col("skip")).alias("place"), F.coalesce("w", far).alias("reachability"), F.when(held <= max_eps, held).otherwise(far).alias("core")))
    if xi is None:
        return out.withColumn("label", F.lit(-1).cast("long"))
    return out.join(_steep(out, xi), "place").select("id", "place", "reachability", "core", "label")


def _steep(plot: DataFrame, xi: float) -> DataFrame:
    """(place, label) of a reachability plot: each stretch ends at a rise (or next to an infinite value) and begins at the first fall after the one before."""
    ahead = plot.select((F.col("place") - 1).alias("at"), F.col("reachability").alias("next"))
    rows = plot.select("place", F.col("reachability").alias("r")).join(ahead, F.col("place") == F.col("at"), "left")
    infinite = (F.col("r") == float("inf")) | (F.col("next") == float("inf"))
    fall = F.col("next").isNotNull() & ~infinite & (F.col("r") * (1 - xi) >= F.col("next"))
    rise = F.col("next").isNotNull() & (infinite | (~fall & (F.col("r") <= F.col("next") * (1 - xi))))
    marked = stored(rows.select("place", fall.alias("fall"), rise.cast("long").alias("rise")))
    parts = stored(running(marked, "place", "rise", "part"))
    ends = parts.groupBy("part").agg(F.min(F.when(F.col("fall"), F.col("place"))).alias("start"), F.max("place").alias("end")).where("start IS NOT NULL")
    named = ranks(ends, "part", out="label").select(F.col("part").alias("of"), "start", (F.col("label") - 1).alias("label"))
    return parts.join(named, F.col("part") == F.col("of"), "left").select("place", F.when(F.col("place") >= F.col("start"), F.col("label")).otherwise(F.lit(-1)).cast("long").alias("label"))
