"""Flows over edge tables (src, dst, w), w the capacity.

Preflow in sweeps: nodes know their distance to the target over arcs with room; level by
level, from the far ones to the near, excess is pushed one level down.  After a sweep
what is left lies where all ways down are full, so distances grow, and sweeps end when
no excess reaches the target.  Every step is joins and sums over the arc table; only
counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparksci.sources.tables import forget, stored

#: Arcs of one node are dealt to so many parts when its excess is shared out.
PARTS = 64
#: Room below this share of the greatest capacity is none: sums of fractions leave dust.
DUST = 1e-12


def _levels(arcs: DataFrame, target: int, closed: int) -> tuple[DataFrame, int]:
    """(id, d): hops to the target over arcs with room, not through the node ``closed``; and the greatest."""
    spark = arcs.sparkSession
    known, depth = stored(spark.createDataFrame([(target, 0)], "id long, d int")), 0
    room = arcs.where((F.col("room") > 0) & (F.col("u") != closed)).select("u", "v")
    while True:
        edge = known.where(F.col("d") == depth).select(F.col("id").alias("v"))
        new = room.join(edge, "v").select(F.col("u").alias("id")).distinct().join(known.select("id"), "id", "left_anti").withColumn("d", F.lit(depth + 1))
        grown = stored(known.unionByName(new))
        if grown.where(F.col("d") == depth + 1).isEmpty():
            forget(grown)
            return known, depth
        forget(known)
        known, depth = grown, depth + 1


def _shared_out(arcs: DataFrame, excess: DataFrame) -> DataFrame:
    """(u, v, push): a node's excess goes into its arcs (u, v, room) one after the other, as far as each has room.

    Arcs of a node are dealt to parts, whose sums say where each part begins, so a node with many arcs meets in no one task.
    """
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS))
    held = arcs.join(excess.select(F.col("id").alias("u"), "e"), "u").withColumn("part", part)
    sums = held.groupBy("u", "part").agg(F.sum("room").alias("all"))
    before = Window.partitionBy("u").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows at most
    sums = sums.select("u", "part", F.coalesce(F.sum("all").over(before), F.lit(0.0)).alias("base"))
    own = Window.partitionBy("u", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    met = held.withColumn("mine", F.coalesce(F.sum("room").over(own), F.lit(0.0))).join(sums, ["u", "part"])
    push = F.least(F.col("room"), F.greatest(F.col("e") - F.col("base") - F.col("mine"), F.lit(0.0)))
    return met.select("u", "v", push.alias("push")).where("push > 0")


def _pushed(arcs: DataFrame, excess: DataFrame, pushes: DataFrame, dust: float) -> tuple[DataFrame, DataFrame]:
    """Arcs and excesses after pushes; written."""
    moved = pushes.select("u", "v", (-F.col("push")).alias("change")).union(pushes.select("v", "u", "push")).groupBy("u", "v").agg(F.sum("change").alias("change"))
    room = F.col("room") + F.coalesce("change", F.lit(0.0))
    new_arcs = stored(arcs.join(moved, ["u", "v"], "left").select("u", "v", "cap", F.when(room > dust, room).otherwise(0.0).alias("room")))
    gained = pushes.select(F.col("u").alias("id"), (-F.col("push")).alias("g")).union(pushes.select("v", "push")).groupBy("id").agg(F.sum("g").alias("g"))
    both = excess.join(gained, "id", "full").select("id", (F.coalesce("e", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("e"))
    new_excess = stored(both.where(F.abs("e") > dust))
    return new_arcs, new_excess


def _drain(arcs: DataFrame, excess: DataFrame, target: int, closed: int, dust: float) -> tuple[DataFrame, DataFrame]:
    """Push excess to the target until none of it can reach it; ``closed`` takes no part."""
    while True:
        levels, depth = _levels(arcs, target, closed)
        active = excess.where(F.col("id") != closed).join(levels.where("d > 0"), "id")
        if active.isEmpty():
            forget(levels)
            return arcs, excess
        for level in range(depth, 0, -1):
            here = excess.where(F.col("id") != closed).join(levels.where(F.col("d") == level), "id").select("id", "e")
            down = levels.where(F.col("d") == level - 1).select(F.col("id").alias("v"))
            ways = arcs.where("room > 0").join(here.select(F.col("id").alias("u")), "u", "left_semi").join(down, "v", "left_semi")
            pushes = stored(_shared_out(ways.select("u", "v", "room"), here))
            if not pushes.isEmpty():
                old = arcs, excess
                arcs, excess = _pushed(arcs, excess, pushes, dust)
                forget(*old)
            forget(pushes)
        forget(levels)


def max_flow(edges: DataFrame, source: int, sink: int) -> tuple[float, DataFrame]:
    """The greatest flow from source to sink, and (src, dst, flow) of the edges that carry some.

    Capacities of parallel edges add up; edges without capacity, or null, and loops carry nothing. Opposite edges
    carry the net flow one way only. The excess that cannot reach the sink goes back to the source.
    """
    if source == sink:
        raise ValueError("source and sink are one node")
    given = edges.where("w > 0 AND src <> dst").groupBy(F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.sum("w").alias("cap"))
    both = given.union(given.select("v", "u", F.lit(0.0))).groupBy("u", "v").agg(F.sum("cap").alias("cap"))
    arcs = stored(both.select("u", "v", "cap", F.col("cap").alias("room")))
    dust = (arcs.agg(F.max("cap")).first()[0] or 0.0) * DUST
    start = stored(arcs.where((F.col("u") == source) & (F.col("room") > 0)).select("u", "v", F.col("room").alias("push")))
    none = arcs.sparkSession.createDataFrame([], "id long, e double")
    full, excess = _pushed(arcs, none, start, dust)
    forget(arcs, start)
    excess = excess.where(F.col("id") != source)
    arcs, excess = _drain(full, excess, sink, source, dust)
    reached = excess.where(F.col("id") == sink).agg(F.sum("e")).first()[0] or 0.0
    rest = excess.where((F.col("id") != sink) & (F.col("id") != source))
    arcs, _ = _drain(arcs, rest, source, sink, dust)
    flow = F.col("cap") - F.col("room")
    return float(reached), arcs.where(flow > dust).select(F.col("u").alias("src"), F.col("v").alias("dst"), flow.alias("flow"))


def min_cut(edges: DataFrame, flow: DataFrame, source: int) -> DataFrame:
    """(src, dst, w): the edges out of what the source still reaches beside a greatest flow; their capacities add up to it."""
    given = edges.where("w > 0 AND src <> dst").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    used = flow.groupBy("src", "dst").agg(F.sum("flow").alias("flow"))
    left = given.join(used, ["src", "dst"], "left").select("src", "dst", "w", (F.col("w") - F.coalesce("flow", F.lit(0.0))).alias("room"))
    dust = (given.agg(F.max("w")).first()[0] or 0.0) * DUST
    ways = stored(left.where(F.col("room") > dust).select(F.col("dst").alias("u"), F.col("src").alias("v"), F.lit(1.0).alias("room")).union(used.where(F.col("flow") > dust).select("src", "dst", F.lit(1.0))))
    inside, _ = _levels(ways, source, -1)  # arcs turned round, so hops to the source are hops from it
    near = given.join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    return near.join(inside.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "w")


def _prices(arcs: DataFrame, source: int, dust: float) -> DataFrame:
    """(id, price): the least cost of a way from the source over arcs (u, v, cost, room) with room; written.

    Only nodes that became cheaper are looked at again. A way of least cost visits no node twice, so a round more than
    there are nodes tells of a cycle of negative cost.
    """
    spark = arcs.sparkSession
    open_arcs = arcs.where("room > 0").groupBy("u", "v").agg(F.min("cost").alias("cost"))
    known = stored(spark.createDataFrame([(source, 0.0, True)], "id long, price double, fresh boolean"))
    rounds, most = 0, None
    while True:
        tried = open_arcs.join(known.where("fresh").select(F.col("id").alias("u"), "price"), "u").groupBy(F.col("v").alias("id")).agg(F.min(F.col("price") + F.col("cost")).alias("tried"))
        cheaper = F.col("price").isNull() | (F.col("tried") < F.col("price") - dust)
        new = stored(known.drop("fresh").join(tried, "id", "full").select("id", F.when(cheaper, F.coalesce("tried", "price")).otherwise(F.col("price")).alias("price"), (F.col("tried").isNotNull() & cheaper).alias("fresh")))
        forget(known)
        known, rounds = new, rounds + 1
        if known.where("fresh").isEmpty():
            return known
        if rounds % 16 == 0:
            most = most or arcs.select("u").union(arcs.select("v")).distinct().count()
            if rounds > most:
                raise ValueError("the network has a cycle of negative cost")


def min_cost_flow(edges: DataFrame, source: int, sink: int, limit: float | None = None) -> tuple[float, float, DataFrame]:
    """The amount of the greatest flow, or of ``limit`` if that is less, its least cost, and (src, dst, cost, flow) of the edges that carry some.

    Edges are (src, dst, w, cost), cost a unit, null for none; parallel edges of one cost are one edge, those of different
    costs stay apart. Edges without capacity, or null, and loops carry nothing. Costs may be negative, cycles of
    negative cost raise.

    Prices are the least costs of ways from the source over what room is left; the arcs that such ways use cost
    nothing beside the prices, and a greatest flow over these alone goes in one phase. Then all ways of that cost are full, so
    there are as many phases as costs of a way, and never an arc with room that the prices say is worth turning back
    (``reduced_costs``).
    """
    if source == sink:
        raise ValueError("source and sink are one node")
    given = edges.where("w > 0 AND src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost"), "w")
    state = stored(given.groupBy("src", "dst", "cost").agg(F.sum("w").cast("double").alias("cap"), F.lit(0.0).alias("flow")))
    top = state.agg(F.max("cap").alias("cap"), F.max(F.abs("cost")).alias("cost")).first()
    dust, cents = (top["cap"] or 0.0) * DUST, (top["cost"] or 0.0) * 1e-9
    amount = 0.0
    while limit is None or limit - amount > dust:
        arcs = stored(_residual(state, dust))
        prices = _prices(arcs, source, cents)
        if prices.where(F.col("id") == sink).isEmpty():
            forget(arcs, prices)
            break
        price = prices.select("id", "price")
        beside = arcs.join(price.withColumnsRenamed({"id": "u", "price": "pu"}), "u").join(price.withColumnsRenamed({"id": "v", "price": "pv"}), "v")
        tight = stored(beside.where((F.col("room") > 0) & (F.abs(F.col("pu") + F.col("cost") - F.col("pv")) <= 4 * cents)).select("u", "v", "cost", "room", "back"))
        forget(arcs, prices)
        net = tight.groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.sum("room").alias("w"))
        start = source
        if limit is not None:
            # A node before the source lets no more pass than is asked for.
            start = tight.agg(F.least(F.min("u"), F.min("v"))).first()[0] - 1
            net = net.union(net.sparkSession.createDataFrame([(start, source, limit - amount)], "src long, dst long, w double"))
        more, used = max_flow(net, start, sink)
        if more <= dust:
            forget(tight)
            break
        # Both directions of an edge, or edges there and back of opposite cost, may share a pair of nodes: a few rows.
        before = Window.partitionBy("u", "v").orderBy("back", "cost").rowsBetween(Window.unboundedPreceding, -1)
        shared = tight.withColumn("base", F.coalesce(F.sum("room").over(before), F.lit(0.0))).join(used.select(F.col("src").alias("u"), F.col("dst").alias("v"), "flow"), ["u", "v"])
        took = shared.withColumn("took", F.least(F.col("room"), F.col("flow") - F.col("base"))).where("took > 0")
        forth = took.where("NOT back").select(F.col("u").alias("src"), F.col("v").alias("dst"), "cost", "took")
        home = took.where("back").select(F.col("v").alias("src"), F.col("u").alias("dst"), (-F.col("cost")).alias("cost"), (-F.col("took")).alias("took"))
        change = forth.union(home).groupBy("src", "dst", F.col("cost") + F.lit(0.0)).agg(F.sum("took").alias("took")).toDF("src", "dst", "cost", "took")
        flow = F.col("flow") + F.coalesce("took", F.lit(0.0))
        new = stored(state.join(change, ["src", "dst", "cost"], "left").select("src", "dst", "cost", "cap", F.when(flow > dust, F.least(flow, F.col("cap"))).otherwise(0.0).alias("flow")))
        forget(state, tight)
        state, amount = new, amount + more
    cost = state.agg(F.sum(F.col("flow") * F.col("cost"))).first()[0] or 0.0
    return amount, float(cost), state.where("flow > 0").select("src", "dst", "cost", "flow")


def _residual(state: DataFrame, dust: float) -> DataFrame:
    """(u, v, cost, room, back): what edges (src, dst, cost, cap, flow) can still take, and can give back."""
    left = F.col("cap") - F.col("flow")
    forth = state.select(F.col("src").alias("u"), F.col("dst").alias("v"), "cost", F.when(left > dust, left).otherwise(0.0).alias("room"), F.lit(False).alias("back"))
    return forth.union(state.select("dst", "src", F.lit(0.0) - F.col("cost"), "flow", F.lit(True))).where("room > 0")


def reduced_costs(edges: DataFrame, flow: DataFrame, source: int) -> DataFrame:
    """(u, v, reduced): cost and prices of every arc that has room beside a flow, among nodes that the source still reaches.

    None is negative if and only if no cycle among them would make the flow cheaper; where there is one, it raises.
    """
    given = edges.where("w > 0 AND src <> dst").groupBy("src", "dst", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost")).agg(F.sum("w").cast("double").alias("cap"))
    state = given.join(flow.select("src", "dst", "cost", "flow"), ["src", "dst", "cost"], "left").select("src", "dst", "cost", "cap", F.coalesce("flow", F.lit(0.0)).alias("flow"))
    top = given.agg(F.max("cap").alias("cap"), F.max(F.abs("cost")).alias("cost")).first()
    arcs = stored(_residual(state, (top["cap"] or 0.0) * DUST))
    price = _prices(arcs, source, (top["cost"] or 0.0) * 1e-9).select("id", "price")
    beside = arcs.join(price.withColumnsRenamed({"id": "u", "price": "pu"}), "u").join(price.withColumnsRenamed({"id": "v", "price": "pv"}), "v")
    return beside.select("u", "v", (F.col("cost") + F.col("pu") - F.col("pv")).alias("reduced"))
