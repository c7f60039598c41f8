"""Agglomerative clustering of all five reducible linkages, from points or from a table of distances.

A round merges every pair of clusters that are each other's nearest.  None of these
linkages brings a merged cluster nearer to others than its parts were, so the merges of
a round do not disturb each other and the tree is that of one merge at a time.  Equal
distances go by the clusters' greatest ids, which keeps this true for ties.

A round is one aggregate over pairs for the nearest, and one over those pairs that a
merge touches for their new distances; other pairs pass by without a shuffle.  When
FINISH clusters or fewer are left, one task merges them to the end.

From points no pair is written: distances of clusters are computed from their points
whenever they are asked for, block by block, and Ward's from their centroids.  A cluster
remembers its nearest one and is searched again only when it or that one was merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.operators import graph
from sparksci.operators.density import numbered
from sparksci.operators.spatial import RowDistances, pdist
from sparksci.operators.statistics import ranks
from sparksci.sources.tables import forget, stored

METHODS = ("single", "complete", "average", "weighted", "ward")
#: Clusters that one task merges to the end: its matrix holds FINISH squared numbers.
FINISH = 1024
#: Rows of a block, about, and blocks that a task takes from one side.
BLOCK, SIDE = 2048, 16
#: Metrics that blocks compute, for components below GREAT.
METRICS, GREAT = ("euclidean", "sqeuclidean", "manhattan", "cosine"), 1e150
BLOCKS = "block long, ids array<long>, starts array<long>, split array<boolean>, w binary, v binary"
MERGE = "round long, gone long, kept long, d double, distance double, size long, least_a long, least_b long, from_a long, from_b long"


def _merged(method: str) -> Column:
    """The distance of two clusters after a round, over the rows (d, na, nb, ha, hb, all_a, all_b) of their parts' pairs.

    n counts the points of a part, all those of its cluster, h is the distance at which the cluster was merged in this round, or 0.
    """
    if method == "single":
        return F.min("d")
    if method == "complete":
        return F.max("d")
    if method == "weighted":
        return F.avg("d")
    if method == "average":
        return F.sum(F.col("na") * F.col("nb") * F.col("d")) / F.max(F.col("all_a") * F.col("all_b"))
    within = F.max(F.col("all_b") * F.col("ha") ** 2 + F.col("all_a") * F.col("hb") ** 2)
    between = F.sum((F.col("na") + F.col("nb")) * F.col("d") ** 2)
    return F.sqrt(F.greatest(F.lit(0.0), (between - within) / F.max(F.col("all_a") + F.col("all_b"))))


def _last_rounds(method: str, first_round: int):
    """One merge at a time over a matrix of at most FINISH clusters."""

    def run(pairs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        state = state.sort_values("id")
        ids, n, h, least = (state[c].to_numpy().copy() for c in ("id", "n", "h", "least"))
        last = [None if pd.isna(x) else int(x) for x in state["last"]]
        d, out = np.full((len(ids), len(ids)), np.inf), []
        i, j = np.searchsorted(ids, pairs["a"]), np.searchsorted(ids, pairs["b"])
        d[i, j] = d[j, i] = pairs["d"]
        for step in range(len(ids) - 1):
            i, j = divmod(int(d.argmin()), len(ids))  # the first of equal ones, so i < j
            at = d[i, j]
            h[j] = max(at, h[i], h[j])
            out.append((first_round + step, ids[i], ids[j], at, h[j], n[i] + n[j], least[i], least[j], last[i], last[j]))
            rest = np.isfinite(d[i]) & np.isfinite(d[j])
            x, y, m = d[i, rest], d[j, rest], n[rest]
            if method == "ward":
                new = np.sqrt(np.maximum(0, ((n[i] + m) * x**2 + (n[j] + m) * y**2 - m * at**2) / (n[i] + n[j] + m)))
            else:
                new = {"single": np.minimum(x, y), "complete": np.maximum(x, y), "weighted": (x + y) / 2, "average": (n[i] * x + n[j] * y) / (n[i] + n[j])}[method]
            d[i], d[:, i] = np.inf, np.inf
            d[j, rest] = d[rest, j] = new
            n[j], least[j], last[j] = n[i] + n[j], min(least[i], least[j]), int(ids[i])
        columns = [c.split()[0] for c in MERGE.split(", ")]
        frame = pd.DataFrame(out, columns=columns)
        return frame.astype({"from_a": "Int64", "from_b": "Int64"})

    return run


def _round(pairs: DataFrame, state: DataFrame, number: int, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges of one round, and pairs and clusters after it; all written."""
    key = F.struct("d", "a", "b")
    nearest = pairs.select(F.explode(F.array("a", "b")).alias("id"), key.alias("k")).groupBy("id").agg(F.min("k").alias("k"))
    mutual = nearest.groupBy("k").count().where("count = 2").select("k.*")
    a, b = (state.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("h").alias(f"h{s}"), F.col("least").alias(f"least_{s}"), F.col("last").alias(f"from_{s}")) for s in "ab")
    met = mutual.join(a, "a").join(b, "b")
    merges = stored(
        met.select(
            F.lit(number).cast("long").alias("round"), F.col("a").alias("gone"), F.col("b").alias("kept"), "d", F.greatest("d", "ha", "hb").alias("distance"),
            (F.col("na") + F.col("nb")).alias("size"), "least_a", "least_b", "from_a", "from_b",
        )
    )
    ends = merges.select(F.explode(F.array("gone", "kept")).alias("id"), "gone", "kept", "d", "distance", "size", F.least("least_a", "least_b").alias("low"))
    held = state.join(ends, "id", "left")
    clusters = stored(
        held.where("gone IS NULL OR kept = id").select(
            "id", F.coalesce("size", "n").alias("n"), F.coalesce("distance", "h").alias("h"), F.coalesce("low", "least").alias("least"), F.coalesce("gone", "last").alias("last")
        )
    )
    part = lambda s: held.select(F.col("id").alias(s), F.coalesce("kept", "id").alias(f"to_{s}"), F.col("n").alias(f"n{s}"), F.coalesce("size", "n").alias(f"all_{s}"), F.coalesce("d", F.lit(0.0)).alias(f"h{s}"), F.col("kept").isNotNull().alias(f"new_{s}"))
    both = pairs.join(part("a"), "a").join(part("b"), "b")
    touched = both.where("(new_a OR new_b) AND to_a <> to_b")
    new = touched.groupBy(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).agg(_merged(method).alias("d"))
    return merges, stored(both.where("NOT new_a AND NOT new_b").select("a", "b", "d").unionByName(new)), clusters


def linkage(distances: DataFrame, points: DataFrame, method: str = "complete", finish: int = FINISH) -> DataFrame:
    """(step, a, b, distance, size, left, right, size_left): the merges in order, as many as points less one.

    ``distances`` holds (i, j, distance) once for every pair of the ids in ``points``, in either order; where a pair is
    missing, doubled, null or not finite, it raises, as no linkage is defined then. Pairs of an id with itself and null ids
    are left out. a < b are the least ids of the two clusters. left < right number them: the points from 0 in order of id,
    then the merges by step. Ward expects Euclidean distances. No points, or one, give no merge.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    spark = points.sparkSession
    ids = stored(points.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct())
    k = ids.count()
    given = distances.where("i <> j").select(F.least("i", "j").cast("long").alias("a"), F.greatest("i", "j").cast("long").alias("b"), F.col("distance").cast("double").alias("d"))
    pairs = stored(given.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi"))
    sound = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNotNull() & (F.abs("d") < float("inf"))).alias("sound")).first()
    if not sound["n"] == sound["sound"] == k * (k - 1) // 2 or not pairs.groupBy("a", "b").count().where("count > 1").isEmpty():
        raise ValueError("every pair of points needs one finite distance")
    state = stored(ids.select("id", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("h"), F.col("id").alias("least"), F.lit(None).cast("long").alias("last")))
    parts, left, number = [], k, 0
    while left > max(1, finish):
        merges, new_pairs, new_state = _round(pairs, state, number, method)
        forget(pairs, state)
        pairs, state, number = new_pairs, new_state, number + 1
        left -= merges.count()
        parts.append(merges)
    one = F.lit(0).alias("all")
    parts.append(stored(pairs.groupBy(one).cogroup(state.groupBy(one)).applyInPandas(_last_rounds(method, number), MERGE)))
    out = _named(parts, ids, k)
    forget(pairs, state)
    return out


def _named(parts: list[DataFrame], ids: DataFrame, k: int) -> DataFrame:
    """The merges of all rounds, put in order and numbered."""
    merges = ids.sparkSession.read.schema(parts[0].schema).parquet(*(p._stored for p in parts))
    # A round's merges precede those of later rounds, also at equal distances.
    ordered = ranks(merges, "distance", tie=("round", "gone"), out="step").withColumn("node", F.col("step") + (k - 1))
    forget(*parts)
    number_of = ranks(ids, "id").select("id", (F.col("rank") - 1).alias("point"))
    named = ordered.select(F.col("gone").alias("name"), "node")
    out = ordered
    for s in "ab":
        # A side is the merge that made it, named by the cluster that went then, or a point.
        out = out.join(named.withColumnsRenamed({"name": f"from_{s}", "node": f"node_{s}"}), f"from_{s}", "left").join(number_of.withColumnsRenamed({"id": f"least_{s}", "point": f"point_{s}"}), f"least_{s}")
        out = out.withColumn(f"side_{s}", F.coalesce(f"node_{s}", f"point_{s}"))
    sizes = ordered.select("node", F.col("size").alias("size_left"))
    out = out.select("step", F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"), "distance", "size", F.least("side_a", "side_b").alias("left"), F.greatest("side_a", "side_b").alias("right"))
    return out.join(sizes.withColumnRenamed("node", "left"), "left", "left").select("step", "a", "b", "distance", "size", "left", "right", F.coalesce("size_left", F.lit(1)).cast("long").alias("size_left"))


def _steady(d):
    """Distances to 41 bits, so that equal ones compare equal whatever the order of their sums."""
    wide = d * 4097.0
    return wide - (wide - d)


def _packed(rows: DataFrame, total: int, per: int) -> DataFrame:
    """BLOCKS of about ``per`` rows (cluster, m, at, w, v): clusters lie whole in a block, those of more than a quarter's rows are split."""
    n = max(1, -(-total // per))
    chunks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("m") * 4 / per))
    dealt = rows.withColumn("block", F.pmod(F.pmod(F.xxhash64("cluster"), F.lit(n)) + F.pmod(F.xxhash64("at"), chunks), F.lit(n)))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cluster", "at"])
        ids, starts = np.unique(pdf["cluster"].to_numpy(), return_index=True)
        split = (pdf["chunks"] > 1).to_numpy()[starts]
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "ids": [ids], "starts": [starts], "split": [split], "w": [pdf["w"].to_numpy(float).tobytes()], "v": [v.tobytes()]})

    return stored(dealt.withColumn("chunks", chunks).select("block", "cluster", "at", "chunks", "w", "v").groupBy("block").applyInPandas(pack, BLOCKS))


def _meeting(method: str, metric: str, every: bool):
    """Rows (q, t, d) of pairs of blocks: each cluster's nearest one there, and its share of the distance to those that are split.

    With ``every`` the share of each pair, once in the order of ids.
    """
    reduced = {"single": np.minimum, "complete": np.maximum}.get(method, np.add)
    weighed = method in ("average", "weighted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                wq, wt = np.frombuffer(row.w), np.frombuffer(row.w2)
                x, y = np.frombuffer(row.v).reshape(len(wq), -1), np.frombuffer(row.v2).reshape(len(wt), -1)
                ids, starts, to, to_starts = (np.asarray(c) for c in (row.ids, row.starts, row.ids2, row.starts2))
                ends = np.append(starts[1:], len(x))
                split, to_split = np.asarray(row.split, bool), np.asarray(row.split2, bool)
                parts, near = [0], []
                while parts[-1] < len(ids):
                    parts.append(max(parts[-1] + 1, int(np.searchsorted(ends, starts[parts[-1]] + 64, "right"))))
                spans = list(zip(parts[:-1], parts[1:], strict=True))
                # New arrays of this size cost more than what fills them, so each step has one for all parts.
                longest = max(ends[last - 1] - starts[first] for first, last in spans)
                distances = RowDistances(y, "sqeuclidean" if method == "ward" else metric, longest)
                whole, summed, joint = np.empty((longest, len(y))), np.empty((longest, len(to))), np.empty((longest, len(to)))
                close = np.empty((longest, len(to)), bool)
                for first, last in spans:
                    part = slice(starts[first], ends[last - 1])
                    d = distances(x[part])
                    if method == "ward":
                        between = np.add(1 / wq[part, None], 1 / wt, out=whole[: len(d)])
                        d *= np.divide(2, between, out=between)
                        np.sqrt(d, out=d)
                    else:
                        if weighed:
                            d *= wq[part, None]
                            d *= wt
                        if len(y) > len(to):  # along rows first: they lie together
                            d = reduced.reduceat(d, to_starts, axis=1, out=summed[: len(d)])
                        if len(d) > last - first:  # reduceat along the other axis is ten times slower than this
                            for k, (begin, end) in enumerate(zip(starts[first:last] - starts[first], ends[first:last] - starts[first], strict=True)):
                                reduced.reduce(d[begin:end], axis=0, out=joint[k])
                            d = joint[: last - first]
                    own = ids[first:last]
                    if every:
                        i, j = np.nonzero(own[:, None] < to)
                        yield pd.DataFrame({"q": own[i], "t": to[j], "d": d[i, j]})
                    else:
                        _, i, j = np.intersect1d(own, to, assume_unique=True, return_indices=True)
                        d[i, j] = np.inf
                        if to_split.any() or split[first:last].any():
                            i, j = np.nonzero((split[first:last, None] | to_split) & (own[:, None] != to))
                            if len(i):
                                yield pd.DataFrame({"q": own[i], "t": to[j], "d": d[i, j]})
                            d[i, j] = np.inf
                        least = d.min(1)
                        held = np.less_equal(d, (least + 1e-11 * np.abs(least))[:, None], out=close[: last - first])
                        i, j = (np.arange(len(d)), d.argmin(1)) if np.count_nonzero(held) == len(d) else np.nonzero(held)
                        i, j = i[np.isfinite(d[i, j])], j[np.isfinite(d[i, j])]
                        at = _steady(d[i, j])
                        order = np.lexsort((j, at, i))  # of equal ones the least id
                        kept = order[np.diff(i[order], prepend=-1) > 0]
                        near.append((own[i[kept]], to[j[kept]], at[kept]))
                if near:
                    yield pd.DataFrame({name: np.concatenate(c) for name, c in zip("qtd", zip(*near, strict=True), strict=True)})

    return run


def _met(queries: DataFrame, blocks: DataFrame, n: tuple[int, int], method: str, metric: str, every: bool) -> DataFrame:
    """(q, t, d) of clusters in n[0] blocks against those in n[1]; nothing but points is moved, and a task holds SIDE pairs of blocks, about."""
    other = blocks.select(*(F.col(c).alias(f"{c}2") for c in ("ids", "starts", "split", "w", "v"))).repartition(max(1, -(-n[1] // SIDE)))
    both = queries.drop("block").repartition(max(1, n[0])).crossJoin(other.hint("shuffle_replicate_nl"))
    share = both.mapInPandas(_meeting(method, metric, every), "q long, t long, d double")
    whole = {"single": F.min("d"), "complete": F.max("d"), "ward": F.min("d")}.get(method, F.sum("d"))
    return share.groupBy("q", "t").agg(whole.alias("d")).withColumn("d", _steady(F.col("d")))


def _copies(points: DataFrame) -> DataFrame:
    """(id, v, k, n, first, before, next): points of one vector, counted in order of id; they merge at 0 before all else."""
    same = Window.partitionBy("v")
    order = same.orderBy("id")
    return points.select(
        "id", "v", F.row_number().over(order).cast("long").alias("k"), F.count("*").over(same).alias("n"), F.min("id").over(same).alias("first"), F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("next")
    )


def _from_blocks(points: DataFrame, method: str, metric: str, finish: int) -> DataFrame:
    """``linkage`` of points without a table of pairs; ids are distinct, components are finite.

    Members are distinct vectors with their weight in their cluster (Ward: one centroid a cluster with its count).
    """
    spark = points.sparkSession
    copies = stored(_copies(points))
    none = F.lit(None).cast("long")
    joined = copies.where("next IS NOT NULL").select(
        (F.col("k") - 1).alias("round"), F.col("id").alias("gone"), F.col("next").alias("kept"), F.lit(0.0).alias("d"), F.lit(0.0).alias("distance"), (F.col("k") + 1).alias("size"),
        F.col("first").alias("least_a"), F.col("next").alias("least_b"), F.col("before").alias("from_a"), none.alias("from_b"),
    )
    parts = [stored(joined)]
    tops = copies.where("next IS NULL")
    clusters = stored(tops.select("id", "n", F.lit(1).cast("long").alias("m"), F.lit(0.0).alias("h"), F.col("first").alias("least"), F.col("before").alias("last"), none.alias("nn"), F.lit(None).cast("double").alias("nd")))
    members = stored(tops.select(F.col("id").alias("cluster"), F.col("id").alias("at"), (F.col("n").cast("double") if method == "ward" else F.lit(1.0)).alias("w"), "v"))
    total = copies.agg(F.count("*").alias("k"), F.coalesce(F.max("n"), F.lit(1)).alias("number")).first()
    k, number, left = total["k"], total["number"], clusters.count()
    ids = stored(copies.select("id"))
    forget(copies)
    held = left
    while left > max(1, finish):
        per = min(BLOCK, max(64, held // 16))
        now = members.join(clusters.select(F.col("id").alias("cluster"), "m", F.col("nn").isNull().alias("lost")), "cluster")
        asked = clusters.where("nn IS NULL").agg(F.sum("m")).first()[0]
        blocks = _packed(now, held, per)
        queries = blocks if asked == held else _packed(now.where("lost"), asked, per)
        near = _met(queries, blocks, (-(-asked // per), -(-held // per)), method, metric, False).groupBy("q").agg(F.min(F.struct("d", "t")).alias("near"))
        found = stored(clusters.join(near, F.col("id") == F.col("q"), "left").select("id", "n", "m", "h", "least", "last", F.coalesce("nn", "near.t").alias("nn"), F.coalesce("nd", "near.d").alias("nd")))
        merges, new_clusters, new_members = _joined(found, members, number, method)
        forget(clusters, members, blocks, queries, found)
        clusters, members, number = new_clusters, new_members, number + 1
        gone = merges.count()
        left -= gone
        held -= gone if method == "ward" else 0
        parts.append(merges)
    per = min(BLOCK, max(64, held // 16))
    blocks = _packed(members.join(clusters.select(F.col("id").alias("cluster"), "m"), "cluster"), held, per)
    n = -(-held // per)
    pairs = stored(_met(blocks, blocks, (n, n), method, metric, True).select(F.col("q").alias("a"), F.col("t").alias("b"), "d"))
    one = F.lit(0).alias("all")
    parts.append(stored(pairs.groupBy(one).cogroup(clusters.select("id", "n", "h", "least", "last").groupBy(one)).applyInPandas(_last_rounds(method, number), MERGE)))
    forget(pairs, clusters, members, blocks)
    return _named(parts, ids, k)


def _joined(found: DataFrame, members: DataFrame, number: int, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges of clusters that are each other's nearest; clusters and members after them; all written."""
    other = found.select(F.col("id").alias("o"), F.col("nn").alias("o_nn"))
    mutual = found.join(other, (F.col("nn") == F.col("o")) & (F.col("id") == F.col("o_nn"))).where("id < nn").select(F.col("id").alias("a"), F.col("nn").alias("b"), F.col("nd").alias("d"))
    a, b = (found.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("m").alias(f"m{s}"), F.col("h").alias(f"h{s}"), F.col("least").alias(f"least_{s}"), F.col("last").alias(f"from_{s}")) for s in "ab")
    full = lambda met: stored(
        met.join(a, "a").join(b, "b").select(
            F.lit(number).cast("long").alias("round"), F.col("a").alias("gone"), F.col("b").alias("kept"), "d", F.greatest("d", "ha", "hb").alias("distance"),
            (F.col("na") + F.col("nb")).alias("size"), "least_a", "least_b", "from_a", "from_b", (F.col("ma") + F.col("mb")).alias("rows"),
        )
    )
    merges = full(mutual)
    if merges.isEmpty():
        # Digits lost in a tie can close a ring of nearest ones; the least distance of all merges in any case.
        forget(merges)
        merges = full(found.orderBy("nd", F.least("id", "nn"), F.greatest("id", "nn")).limit(1).select(F.least("id", "nn").alias("a"), F.greatest("id", "nn").alias("b"), F.col("nd").alias("d")))
    ends = merges.select(F.explode(F.array("gone", "kept")).alias("end"), "gone", "kept", "distance", "size", "rows", F.least("least_a", "least_b").alias("low"))
    lost = ends.select(F.col("end").alias("was"))
    after = found.join(ends, F.col("id") == F.col("end"), "left").where("gone IS NULL OR kept = id").join(lost, F.col("nn") == F.col("was"), "left")
    known = F.col("gone").isNull() & F.col("was").isNull()
    clusters = stored(
        after.select(
            "id", F.coalesce("size", "n").alias("n"), (F.lit(1).cast("long") if method == "ward" else F.coalesce("rows", "m")).alias("m"), F.coalesce("distance", "h").alias("h"), F.coalesce("low", "least").alias("least"),
            F.coalesce("gone", "last").alias("last"), F.when(known, F.col("nn")).alias("nn"), F.when(known, F.col("nd")).alias("nd"),
        )
    )
    if method == "ward":
        side = lambda s: members.select(F.col("cluster").alias(s), F.col("w").alias(f"w_{s}"), F.col("v").alias(f"v_{s}"))
        w = F.col("w_gone") + F.col("w_kept")
        centroid = F.zip_with("v_gone", "v_kept", lambda x, y: (x * F.col("w_gone") + y * F.col("w_kept")) / w)
        made = merges.select("gone", "kept").join(side("gone"), "gone").join(side("kept"), "kept").select(F.col("kept").alias("cluster"), F.col("kept").alias("at"), w.alias("w"), centroid.alias("v"))
        return merges, clusters, stored(members.join(ends.select(F.col("end").alias("cluster")), "cluster", "left_anti").select("cluster", "at", "w", "v").unionByName(made))
    part = found.select(F.col("id").alias("cluster"), "n").join(ends.select(F.col("end").alias("cluster"), "kept", "size"), "cluster")
    share = F.lit(0.5) if method == "weighted" else F.col("n") / F.col("size")
    moved = members.join(part.select("cluster", "kept", share.alias("share")), "cluster", "left")
    return merges, clusters, stored(moved.select(F.coalesce("kept", "cluster").alias("cluster"), "at", (F.col("w") * F.coalesce("share", F.lit(1.0))).alias("w"), "v"))


def linkage_from_data(points: DataFrame, method: str = "complete", metric: str = "euclidean", finish: int = FINISH) -> DataFrame:
    """``linkage`` of points (id, v) under a metric; points without id or vector, or with a null or NaN in it, take no part.

    Every linkage but single looks at each distance, so the work is quadratic; no pair is written, and tasks hold a few blocks.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if method == "ward" and metric != "euclidean":
        raise ValueError("ward goes by Euclidean distances")
    usable = stored(points.join(numbered(points).select("id"), "id", "left_semi").select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v")))
    great = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    seen = usable.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), great.alias("great"), F.count_if(F.exists("v", lambda x: x != 0)).alias("long")).first()
    if metric not in METRICS or seen["n"] and seen["great"] >= GREAT or metric == "cosine" and seen["long"] < seen["n"]:
        return linkage(pdist(usable, metric), usable, method, finish)
    if seen["n"] > seen["ids"]:
        raise ValueError("every pair of points needs one finite distance")
    return _from_blocks(usable, method, metric, finish)


def cut_tree(points: DataFrame, merges: DataFrame, clusters: list[int]) -> DataFrame:
    """(id, clusters, label) for each number of clusters asked for: the first merges are made, a label is the least id of its cluster.

    More clusters than points give each point its own; fewer than one raises.
    """
    if not clusters or min(clusters) < 1:
        raise ValueError("one cluster at least")
    n, ids = merges.count() + 1, points.where("id IS NOT NULL").select("id").distinct()
    out = None
    for k in clusters:
        links = merges.where(F.col("step") <= n - k).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        part = graph.connected_components(links, ids).select("id", F.lit(k).alias("clusters"), F.col("component").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out


def leaves_list(points: DataFrame, merges: DataFrame) -> DataFrame:
    """(place, id): the points from left to right, so that every cluster is one run; places start at 0.

    A point's place is the sum of the left clusters' sizes that it lies right of, added up on the way to the root by pointer doubling.
    """
    number = ranks(points.where("id IS NOT NULL").select(F.col("id").cast("long").alias("id")).distinct(), "id").select("id", (F.col("rank") - 1).alias("node"))
    up = (F.col("step") + merges.count()).alias("up")
    sides = merges.select(F.col("left").alias("node"), up, F.lit(0).cast("long").alias("add")).unionByName(merges.select(F.col("right").alias("node"), up, F.col("size_left").alias("add")))
    ways = stored(sides)
    while True:
        onward = ways.select(F.col("node").alias("up"), F.col("up").alias("further"), F.col("add").alias("more"))
        new = stored(ways.join(onward, "up", "left").select("node", F.coalesce("further", "up").alias("up"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"), F.col("further").isNotNull().alias("moved")))
        forget(ways)
        if new.where("moved").isEmpty():
            return number.join(new.select("node", "add"), "node", "left").select(F.coalesce("add", F.lit(0)).cast("long").alias("place"), "id")
        ways = new
