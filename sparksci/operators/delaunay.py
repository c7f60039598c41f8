"""Delaunay triangulations and Voronoi diagrams of points in the plane, tile by tile.

Tiles come from repeated quantile splits, so a crowded place gets more of them.  Each tile
is triangulated apart.  A triangle whose circumcircle lies inside its tile holds no point
of another one: it is certified and leaves.  Points at uncertified triangles and on the
tile's hull, and the outline of the certified part, go on to the parent tile, where the
points of four children are triangulated again: what lies outside the outlines is the rest
of the parent's triangulation.  The root gets what no tile could certify, for points
spread over an area some multiple of sqrt(n); points that lie on few circles have no
certified triangle and all reach it.

Ties are settled as if each point were lifted a little, the smaller id the more: four
points on one circle have one triangulation, in every tile and at every tiling.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparksci.sources.tables import forget, stored

#: Most points of a tile that is triangulated at once.
TILE = 2000
#: Children of a split tile.
WAYS = 4
POINT, OUTLINE, TRIANGLE, ASKED, ANSWER = range(5)
FAR = -1  # the vertex at infinity of triangles outside the hull
STATE = "path string, kind int, ids array<long>, xy array<double>, x0 double, x1 double, y0 double, y1 double"


def _turn(a, b, c) -> float:
    """Above 0 if a, b, c turn left; the sign is exact."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    d = left - right
    if abs(d) > 4e-16 * (abs(left) + abs(right)):
        return d
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c))
    exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (exact > 0) - (exact < 0)


def _lifted(rows):
    (ax, ay), (bx, by), (cx, cy) = rows
    terms = ((ax * ax + ay * ay), bx * cy, by * cx), ((bx * bx + by * by), cx * ay, cy * ax), ((cx * cx + cy * cy), ax * by, ay * bx)
    return sum(h * (p - q) for h, p, q in terms), sum(h * (abs(p) + abs(q)) for h, p, q in terms)


class Mesh:
    """The triangulation of a bounded set of distinct points; an index stands for a point, in the order of ids."""

    def __init__(self, at: list[tuple[float, float]]):
        self.at, self.apex, self.hint = at, {}, None
        n = len(at)
        if n < 3:
            return
        strips = max(1, int(math.sqrt(n / 2)))
        by_x = sorted(range(n), key=at.__getitem__)
        wide = -(-n // strips)
        order = []
        for s in range(strips):
            order += sorted(by_x[s * wide : (s + 1) * wide], key=lambda i: at[i][1], reverse=s % 2 == 1)
        a, b = order[:2]
        third = next((k for k in range(2, n) if _turn(at[a], at[b], at[order[k]])), None)
        if third is None:
            return
        c = order.pop(third)
        if _turn(at[a], at[b], at[c]) < 0:
            b, c = c, b
        for t in ((a, b, c), (b, a, FAR), (c, b, FAR), (a, c, FAR)):
            self._add(*t)
        self.hint = a, b
        for p in order[2:]:
            self._insert(p)

    def _add(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b

    def _conflict(self, a: int, b: int, c: int, p: int) -> bool:
        """Whether point p lies inside the circle of the triangle; beyond the edge, or on it, of one at infinity."""
        if FAR in (a, b, c):
            u, v = (a, b) if c == FAR else (b, c) if a == FAR else (c, a)
            side = _turn(self.at[u], self.at[v], self.at[p])
            return side > 0 or side == 0 and min(self.at[u], self.at[v]) < self.at[p] < max(self.at[u], self.at[v])
        px, py = self.at[p]
        d, size = _lifted([(self.at[i][0] - px, self.at[i][1] - py) for i in (a, b, c)])
        if abs(d) > 2e-15 * size:
            return d > 0
        x, y = Fraction(px), Fraction(py)
        d, _ = _lifted([(Fraction(self.at[i][0]) - x, Fraction(self.at[i][1]) - y) for i in (a, b, c)])
        if d:
            return d > 0
        first = min(a, b, c, p)
        if first == p:
            return False
        u, v = (b, c) if first == a else (c, a) if first == b else (a, b)
        return _turn(self.at[p], self.at[u], self.at[v]) > 0

    def locate(self, q: tuple[float, float]) -> tuple[int, int, int]:
        """The triangle that holds q, its edges included; beyond the hull, one at infinity that sees q."""
        a, b = self.hint
        c = self.apex[a, b]
        while True:
            for u, v in ((a, b), (b, c), (c, a)):
                if _turn(self.at[u], self.at[v], q) < 0:
                    a, b, c = v, u, self.apex[v, u]
                    break
            else:
                return a, b, c
            if c == FAR:
                return a, b, c

    def _insert(self, p: int) -> None:
        a, b, c = self.locate(self.at[p])
        apex, open_edges, rim = self.apex, [(a, b), (b, c), (c, a)], []
        for e in open_edges:
            del apex[e]
        while open_edges:
            u, v = open_edges.pop()
            w = apex.get((v, u))
            if w is None:
                continue
            if self._conflict(v, u, w, p):
                del apex[v, u], apex[u, w], apex[w, v]
                open_edges += [(u, w), (w, v)]
            else:
                rim.append((u, v))
        for u, v in rim:
            self._add(u, v, p)
            if FAR not in (u, v):
                self.hint = u, v

    def triangles(self) -> list[tuple[int, int, int]]:
        """Counterclockwise, from the least vertex on."""
        return [(a, b, c) for (a, b), c in self.apex.items() if 0 <= a < b and a < c]

    def within(self, outline: list[tuple[int, int]]) -> set[tuple[int, int, int]]:
        """Triangles to the left of the outline's edges."""
        rim, found = set(outline), set()
        todo = list(rim)
        while todo:
            a, b = todo.pop()
            t = _first(a, b, self.apex[a, b])
            if t in found:
                continue
            found.add(t)
            for i in range(3):
                u, v = t[i], t[(i + 1) % 3]
                if (u, v) not in rim:
                    todo.append((v, u))
        return found


def _first(a: int, b: int, c: int) -> tuple[int, int, int]:
    return (a, b, c) if a < b and a < c else (b, c, a) if b < c else (c, a, b)


def _certified(at: np.ndarray, t: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Which triangles have their circumcircle inside the box for certain, rounding counted; flat ones never have."""
    a, b, c = at[t[:, 0]], at[t[:, 1]] - at[t[:, 0]], at[t[:, 2]] - at[t[:, 0]]
    with np.errstate(all="ignore"):
        area = b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]
        bb, cc = (b * b).sum(1), (c * c).sum(1)
        x = (c[:, 1] * bb - b[:, 1] * cc) / (2 * area)
        y = (b[:, 0] * cc - c[:, 0] * bb) / (2 * area)
        reach = np.hypot(x, y) * (1 + 1e-5) + 1e-12 * np.abs(a).max(1)
        x, y = x + a[:, 0], y + a[:, 1]
        inside = (box[0] < x - reach) & (x + reach < box[1]) & (box[2] < y - reach) & (y + reach < box[3])
        return inside & (area > 1e-9 * np.maximum(bb, cc))


def _tile(rows: pd.DataFrame) -> pd.DataFrame:
    """One tile's state: what is certain leaves as triangles and answers, the rest goes to the parent."""
    path = rows["path"].iloc[0]
    root = path == ""
    box = (rows["x0"].min(), rows["x1"].max(), rows["y0"].min(), rows["y1"].max())
    kinds = {k: part for k, part in rows.groupby("kind")}
    none = rows.iloc[:0]
    held = sorted((int(i[0]), float(p[0]), float(p[1])) for i, p in zip(kinds.get(POINT, none)["ids"], kinds.get(POINT, none)["xy"]))
    ids, at = [h[0] for h in held], [h[1:] for h in held]
    place = {i: k for k, i in enumerate(ids)}
    outline = [(place[int(e[0])], place[int(e[1])]) for e in kinds.get(OUTLINE, none)["ids"]]
    mesh = Mesh(at)
    done = mesh.within(outline)
    mine = [t for t in mesh.triangles() if t not in done]
    sure = np.ones(len(mine), bool) if root else _certified(np.array(at).reshape(-1, 2), np.array(mine, int).reshape(-1, 3), box)
    settled = {t for t, yes in zip(mine, sure) if yes}
    out = [(TRIANGLE, [ids[i] for i in t], [v for i in t for v in at[i]]) for t in settled]

    for asked, q in zip(kinds.get(ASKED, none)["ids"], kinds.get(ASKED, none)["xy"]):
        t = _holder(mesh, (float(q[0]), float(q[1])), done)
        if t in settled:
            out.append((ANSWER, [int(asked[0]), *(ids[i] for i in t)], None))
        elif root:
            out.append((ANSWER, [int(asked[0]), None, None, None], None))
        else:
            out.append((ASKED, asked, q))
    if not root:
        edges = outline + [(t[i], t[(i + 1) % 3]) for t in settled for i in range(3)]
        for u, v in edges:
            w = mesh.apex[v, u]
            across = None if w == FAR else _first(v, u, w)
            if across not in done and across not in settled:
                out.append((OUTLINE, [ids[u], ids[v]], None))
        kept = {i for t in mine if t not in settled for i in t} | {i for (u, v), w in mesh.apex.items() if w == FAR for i in (u, v)}
        for i in kept if mesh.apex else range(len(at)):
            out.append((POINT, [ids[i]], list(at[i])))
    made = pd.DataFrame(out, columns=["kind", "ids", "xy"])
    parent = path.rpartition("/")[0]
    return made.assign(path=parent, x0=box[0], x1=box[1], y0=box[2], y1=box[3])[["path", "kind", "ids", "xy", "x0", "x1", "y0", "y1"]]


def _holder(mesh: Mesh, q: tuple[float, float], done: set) -> tuple[int, int, int] | None:
    """The triangle outside the certified part that holds q; q on the outline is held from beyond it."""
    if not mesh.apex:
        return None
    seen, todo = set(), [mesh.locate(q)]
    while todo:
        t = todo.pop()
        if FAR in t:
            continue
        t = _first(*t)
        if t not in done:
            return t
        seen.add(t)
        for i in range(3):
            u, v = t[i], t[(i + 1) % 3]
            if _turn(mesh.at[u], mesh.at[v], q) == 0 and (w := mesh.apex[v, u]) != FAR and _first(v, u, w) not in seen:
                todo.append((v, u, w))
    return None


def _tiled(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows of STATE with the path of their leaf tile, and the depth of the deepest one; written.

    Every round splits the tiles of more than ``size`` points into WAYS by quantiles, of x and of y in turn.  Distinct points
    cannot all share the least x and the least y, so two rounds always split a tile.
    """
    inf = F.lit(float("inf"))
    now = stored(rows.select(F.lit("").alias("path"), "kind", "ids", "xy", (-inf).alias("x0"), inf.alias("x1"), (-inf).alias("y0"), inf.alias("y1")))
    depth = 0
    while True:
        axis = depth % 2
        value, low, high = F.col("xy")[axis], *(F.col(c) for c in (("x0", "x1"), ("y0", "y1"))[axis])
        cuts = now.where(F.col("kind") == POINT).groupBy("path").agg(F.count("*").alias("n"), F.percentile_approx(value, [k / WAYS for k in range(1, WAYS)], 1000).alias("cuts"))
        cuts = stored(cuts.where(F.col("n") > size).select("path", F.array_distinct("cuts").alias("cuts")))
        if cuts.isEmpty():
            forget(cuts)
            return now, depth
        child = F.size(F.filter("cuts", lambda c: c <= value))
        met = now.join(cuts, "path", "left").withColumn("child", F.when(F.col("cuts").isNotNull(), child))
        split = F.col("child").isNotNull()
        new_low = F.when(split & (F.col("child") > 0), F.try_element_at("cuts", F.greatest("child", F.lit(1)))).otherwise(low)
        new_high = F.when(split & (F.col("child") < F.size("cuts")), F.try_element_at("cuts", F.col("child") + 1)).otherwise(high)
        bounds = {"x0": "x0", "x1": "x1", "y0": "y0", "y1": "y1"} | dict(zip((("x0", "x1"), ("y0", "y1"))[axis], (new_low, new_high)))
        path = F.when(split, F.concat("path", F.lit("/"), F.col("child").cast("string"))).otherwise(F.col("path"))
        then = stored(met.select(path.alias("path"), "kind", "ids", "xy", *((F.col(b) if isinstance(b, str) else b).alias(n) for n, b in bounds.items())))
        forget(now, cuts)
        now, depth = then, depth + 1


def _places(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """(id, x, y): finite ones with an id; an id that repeats has its least place."""
    at = df.select(F.col(id_col).cast("long").alias("id"), (F.col(x).cast("double") + 0.0).alias("x"), (F.col(y).cast("double") + 0.0).alias("y"))
    finite = at.where("id IS NOT NULL AND abs(x) < double('inf') AND abs(y) < double('inf')")
    return finite.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")


def _solved(points: DataFrame, asked: DataFrame | None, size: int, id_col: str, x: str, y: str) -> DataFrame:
    """(kind, ids, xy): triangles and answers; written."""
    at = _places(points, id_col, x, y).groupBy("x", "y").agg(F.min("id").alias("id"))
    rows = at.select(F.lit(POINT).alias("kind"), F.array("id").alias("ids"), F.array("x", "y").alias("xy"))
    if asked is not None:
        rows = rows.unionByName(_places(asked, id_col, x, y).select(F.lit(ASKED).alias("kind"), F.array("id").alias("ids"), F.array("x", "y").alias("xy")))
    leaves, deepest = _tiled(rows, size)
    level = F.size(F.split("path", "/")) - 1
    up, written = None, []
    for depth in range(deepest, -1, -1):
        here = leaves.where(level == depth)
        here = here if up is None else here.unionByName(up)
        # A tile's work grows faster than its bytes: as many tasks as the session has partitions, not merged by size.
        tasks = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = stored(here.repartition(tasks, "path").groupBy("path").applyInPandas(_tile, STATE))
        up = out.where(F.col("kind").isin(POINT, OUTLINE, ASKED))
        written.append(out)
    found = written[0]
    for more in written[1:]:
        found = found.unionByName(more)
    result = stored(found.where(F.col("kind").isin(TRIANGLE, ANSWER)).select("kind", "ids", "xy"))
    forget(leaves, *written)
    return result


def _corners(found: DataFrame) -> DataFrame:
    ids = [F.col("ids")[i].alias(n) for i, n in enumerate("abc")]
    return found.where(F.col("kind") == TRIANGLE).select(*ids, *(F.col("xy")[i].alias(n) for i, n in enumerate(("ax", "ay", "bx", "by", "cx", "cy"))))


def delaunay(points: DataFrame, id_col: str = "id", x: str = "x", y: str = "y", size: int = TILE) -> DataFrame:
    """(a, b, c, ax, ay, bx, by, cx, cy): the triangles, counterclockwise from the least id on.

    Rows without an id or with a null, NaN or infinite coordinate are left out; points at one place count as the one of least id;
    fewer than three points, or all on a line, have no triangles.  Other columns are not read.
    """
    return _corners(_solved(points, None, size, id_col, x, y))


def find_simplex(points: DataFrame, asked: DataFrame, id_col: str = "id", x: str = "x", y: str = "y", size: int = TILE) -> DataFrame:
    """(id, a, b, c): for each asked point the triangle of the points' triangulation that holds it; nulls outside the hull.

    Asked points go with the tiles: the first tile in which a certified triangle holds them answers.  A point on an edge is in one
    of its triangles.  Asked rows are cleaned as points are.
    """
    found = _solved(points, asked, size, id_col, x, y).where(F.col("kind") == ANSWER)
    return found.select(*(F.col("ids")[i].alias(n) for i, n in enumerate(("id", "a", "b", "c"))))


def _sides(triangles: DataFrame) -> DataFrame:
    """(u, v, t): the three directed edges of each triangle, t to their left."""
    t = F.struct("a", "b", "c", *_centre())
    return triangles.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v"), t.alias("t")) for u, v in ("ab", "bc", "ca")))).alias("s")).select("s.*")


def _centre() -> tuple[Column, Column]:
    """Circumcentre columns (vx, vy) of a triangle's row."""
    bx, by, cx, cy = (F.col(p) - F.col(q) for p, q in (("bx", "ax"), ("by", "ay"), ("cx", "ax"), ("cy", "ay")))
    double = 2 * (bx * cy - by * cx)
    bb, cc = bx * bx + by * by, cx * cx + cy * cy
    return (F.col("ax") + F.try_divide(cy * bb - by * cc, double)).alias("vx"), (F.col("ay") + F.try_divide(bx * cc - cx * bb, double)).alias("vy")


def vertex_neighbors(triangles: DataFrame) -> DataFrame:
    """(id, neighbor): points that share an edge, both ways."""
    s = _sides(triangles).select("u", "v")
    return s.union(s.select("v", "u")).distinct().select(F.col("u").alias("id"), F.col("v").alias("neighbor"))


def hull_edges(triangles: DataFrame) -> DataFrame:
    """(u, v): edges of the convex hull, counterclockwise: those that no triangle lies beyond."""
    s = _sides(triangles).select("u", "v")
    return s.join(s.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")


def voronoi_vertices(triangles: DataFrame) -> DataFrame:
    """(a, b, c, vx, vy): the circumcentre of each triangle."""
    return triangles.select("a", "b", "c", *_centre())


def voronoi_ridges(triangles: DataFrame) -> DataFrame:
    """(i, j, x1, y1, x2, y2): the border of the regions of i and j, i < j, from vertex to vertex; a ray has null x2, y2."""
    ends = _sides(triangles).groupBy(F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"))
    ends = ends.agg(F.count("*").alias("n"), F.min(F.struct("t.vx", "t.vy")).alias("p"), F.max(F.struct("t.vx", "t.vy")).alias("q"))
    both = F.col("n") == 2
    return ends.select("i", "j", F.col("p.vx").alias("x1"), F.col("p.vy").alias("y1"), F.when(both, F.col("q.vx")).alias("x2"), F.when(both, F.col("q.vy")).alias("y2"))


def voronoi_regions(triangles: DataFrame) -> DataFrame:
    """(id, n_vertices, n_neighbors, bounded, area): the region of each point; area is null where it has no bound.

    Around an inner point each neighbour follows one triangle and leads the next, so followers and leaders add up to the same; on
    the hull the sums differ by the two ends.  Areas add the signed quarters between a point, two edge middles and a centre.
    """
    vx, vy = _centre()
    corners = []
    for p, q, r in ("abc", "bca", "cab"):
        px, py = F.col(f"{p}x"), F.col(f"{p}y")
        mx, my, nx, ny = ((F.col(f"{o}{k}") - F.col(f"{p}{k}")) / 2 for o in (q, r) for k in "xy")
        wx, wy = F.col("vx") - px, F.col("vy") - py
        part = (mx * wy - my * wx + wx * ny - wy * nx) / 2
        step = F.col(q).cast("decimal(20,0)") - F.col(r).cast("decimal(20,0)")
        corners.append(F.struct(F.col(p).alias("id"), step.alias("step"), part.alias("part")))
    rows = triangles.select("*", vx, vy).select(F.explode(F.array(*corners)).alias("s")).select("s.*")
    by_point = rows.groupBy("id").agg(F.count("*").alias("n_vertices"), (F.sum("step") == 0).alias("bounded"), F.sum("part").alias("part"))
    return by_point.select("id", "n_vertices", (F.col("n_vertices") + F.when(F.col("bounded"), 0).otherwise(1)).alias("n_neighbors"), "bounded", F.when(F.col("bounded"), F.col("part")).alias("area"))
