"""Greatest flows against augmenting paths."""

import random
from collections import defaultdict, deque

import pytest

from sparksci.operators import flow


def by_hand(edges, s, t):
    room = defaultdict(float)
    for u, v, c in edges:
        if u != v and c:
            room[u, v] += c
    nodes = {x for e in edges for x in e[:2]}
    total = 0.0
    while True:
        by, queue = {s: None}, deque([s])
        while queue and t not in by:
            u = queue.popleft()
            for v in nodes:
                if v not in by and room[u, v] > 1e-12:
                    by[v] = u
                    queue.append(v)
        if t not in by:
            return total
        path, v = [], t
        while by[v] is not None:
            path.append((by[v], v))
            v = by[v]
        least = min(room[e] for e in path)
        for u, v in path:
            room[u, v] -= least
            room[v, u] += least
        total += least


def check(spark, edges, s, t):
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    total, used = flow.max_flow(df, s, t)
    rows = [(r["src"], r["dst"], r["flow"]) for r in used.collect()]
    assert total == pytest.approx(by_hand(edges, s, t))
    room, net = defaultdict(float), defaultdict(float)
    for u, v, c in edges:
        room[u, v] += c or 0
    for u, v, f in rows:
        assert 0 < f <= room[u, v] + 1e-9
        net[u] -= f
        net[v] += f
    assert net[t] == pytest.approx(total) and net[s] == pytest.approx(-total)
    assert all(abs(x) < 1e-9 for k, x in net.items() if k not in (s, t))  # nothing stays on the way
    assert sum(r["w"] for r in flow.min_cut(df, used, s).collect()) == pytest.approx(total)
    return total


def test_flow_of_the_small_network(spark):
    assert check(spark, [(0, 1, 10.0), (0, 2, 8.0), (1, 2, 3.0), (1, 3, 5.0), (2, 3, 7.0)], 0, 3) == 12


def test_flows_of_random_networks_equal_augmenting_paths(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12), rng.choice([1.0, 2.0, 2.5, 7.0])) for _ in range(40)]
    edges += [(0, 5, None), (3, 3, 9.0), (7, 8, 0.0), (20, 21, 4.0), (21, 20, 4.0)]  # nulls, loops, nothing, apart
    assert check(spark, edges, 0, 11) > 0


def test_flows_that_turn_back_and_none(spark):
    assert check(spark, [(0, 1, 5.0), (1, 2, 5.0), (2, 3, 5.0), (1, 4, 9.0), (4, 1, 9.0), (3, 5, 1.5)], 0, 5) == 1.5
    df = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    total, used = flow.max_flow(df, 0, 3)
    assert total == 0 and used.count() == 0
    total, used = flow.max_flow(df.where("src < 0"), 0, 3)
    assert total == 0 and used.count() == 0
    with pytest.raises(ValueError):
        flow.max_flow(df, 1, 1)


def cheapest_by_hand(edges, s, t, limit=float("inf")):
    """Shortest ways one after the other; arcs are rows with their turned ones beside them."""
    arcs = []
    for u, v, c, k in edges:
        if u != v and c:
            arcs += [[u, v, c, k or 0.0], [v, u, 0.0, -(k or 0.0)]]
    nodes, total, cost = {x for e in edges for x in e[:2]}, 0.0, 0.0
    while total < limit:
        dist, by = dict.fromkeys(nodes, float("inf")), {}
        dist[s] = 0.0
        for _ in nodes:
            for i, (u, v, room, k) in enumerate(arcs):
                if room > 1e-12 and dist[u] + k < dist[v] - 1e-12:
                    dist[v], by[v] = dist[u] + k, i
        if t not in by:
            break
        path, v = [], t
        while v != s:
            path.append(by[v])
            v = arcs[by[v]][0]
        least = min([arcs[i][2] for i in path] + [limit - total])
        for i in path:
            arcs[i][2] -= least
            arcs[i ^ 1][2] += least
        total, cost = total + least, cost + least * dist[t]
    return total, cost


def check_cost(spark, edges, s, t, limit=None):
    df = spark.createDataFrame(edges, "src long, dst long, w double, cost double")
    total, cost, used = flow.min_cost_flow(df, s, t, limit)
    assert (total, cost) == pytest.approx(cheapest_by_hand(edges, s, t, limit or float("inf")))
    room, net = defaultdict(float), defaultdict(float)
    for u, v, c, k in edges:
        room[u, v, k or 0.0] += c or 0
    rows = [tuple(r) for r in used.select("src", "dst", "cost", "flow").collect()]
    for u, v, k, f in rows:
        assert 0 < f <= room[u, v, k] + 1e-9
        net[u] -= f
        net[v] += f
    assert cost == pytest.approx(sum(k * f for _, _, k, f in rows)) and net[t] == pytest.approx(total)
    assert all(abs(x) < 1e-9 for k, x in net.items() if k not in (s, t))
    assert flow.reduced_costs(df, used, s).where("reduced < -1e-6").isEmpty()  # no way to turn back cheaper
    return total, cost


def test_cheapest_flows_turn_back_where_a_later_way_asks_for_it(spark):
    # The first way, 0-1-2-3, must give back its middle edge.
    assert check_cost(spark, [(0, 1, 1.0, 1.0), (0, 2, 1.0, 5.0), (1, 2, 1.0, 1.0), (1, 3, 1.0, 6.0), (2, 3, 1.0, 1.0)], 0, 3) == (2, 13)


def test_cheapest_flows_of_random_networks(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(7), rng.randrange(7), rng.choice([1.0, 2.5, 4.0]), float(rng.randrange(1, 4))) for _ in range(20)]
    edges += [(0, 3, None, 1.0), (2, 2, 5.0, 1.0), (0, 6, 1.0, None), (0, 6, 1.0, 2.0), (0, 6, 2.0, 2.0), (6, 0, 3.0, 2.0)]
    total, _ = check_cost(spark, edges, 0, 6)
    assert check_cost(spark, edges, 0, 6, limit=total / 2)[0] == pytest.approx(total / 2)


def test_cheapest_flows_with_gains_none_and_cycles(spark):
    assert check_cost(spark, [(0, 1, 2.0, -3.0), (1, 2, 1.0, 1.0), (0, 2, 1.0, -1.0)], 0, 2) == (2, -3)
    df = spark.createDataFrame([(0, 1, 1.0, 1.0), (2, 3, 1.0, 1.0)], "src long, dst long, w double, cost double")
    for edges in (df, df.where("src < 0")):
        total, cost, used = flow.min_cost_flow(edges, 0, 3)
        assert (total, cost, used.count()) == (0, 0, 0)
    with pytest.raises(ValueError, match="one node"):
        flow.min_cost_flow(df, 1, 1)
    loop = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 0, 1.0, -2.0), (1, 2, 1.0, 0.0)], df.schema)
    with pytest.raises(ValueError, match="negative cost"):
        flow.min_cost_flow(loop, 0, 2)
