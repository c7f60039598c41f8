"""Distances and rotations as column expressions over array<double> and struct columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    x = lambda c: c.cast("double")
    if metric == "sqeuclidean":
        return _sum(F.zip_with(a, b, lambda p, q: (x(p) - x(q)) * (x(p) - x(q))))
    if metric == "euclidean":
        return F.sqrt(distance(a, b, "sqeuclidean"))
    if metric == "manhattan":
        return _sum(F.zip_with(a, b, lambda p, q: F.abs(x(p) - x(q))))
    if metric == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(x(p) - x(q))))
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    raise ValueError("metric is euclidean, sqeuclidean, manhattan, chebyshev or cosine")


# --- rotations: struct<w, x, y, z> unit quaternions -------------------------------------------


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable keeps nested expressions from multiplying."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts(**parts: Column) -> Column:
    return F.struct(*(c.cast("double").alias(k) for k, c in parts.items()))


def quat(w: Column, x: Column, y: Column, z: Column) -> Column:
    """A normalised quaternion."""
    unit = lambda p: _parts(**{c: p[c] / p["n"] for c in "wxyz"})
    sized = lambda p: _parts(w=p["w"], x=p["x"], y=p["y"], z=p["z"], n=F.sqrt(p["w"] * p["w"] + p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]))
    return _let(_let(_parts(w=w, x=x, y=y, z=z), sized), unit)


def quat_from_rotvec(x: Column, y: Column, z: Column) -> Column:
    def turn(p: Column) -> Column:
        s = F.when(p["a"] > 0, F.sin(p["a"] / 2) / p["a"]).otherwise(0.5)
        return _parts(w=F.cos(p["a"] / 2), x=p["x"] * s, y=p["y"] * s, z=p["z"] * s)

    sized = lambda p: _parts(x=p["x"], y=p["y"], z=p["z"], a=F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]))
    return _let(_let(_parts(x=x, y=y, z=z), sized), turn)


def quat_from_axis_angle(x: Column, y: Column, z: Column, angle: Column) -> Column:
    n = F.sqrt(x * x + y * y + z * z)
    return quat_from_rotvec(x / n * angle, y / n * angle, z / n * angle)


def quat_multiply(a: Column, b: Column) -> Column:
    def product(two: Column) -> Column:
        w, x, y, z = (two["a"][c] for c in "wxyz")
        p, q, r, s = (two["b"][c] for c in "wxyz")
        return quat(w * p - x * q - y * r - z * s, w * q + x * p + y * s - z * r, w * r - x * s + y * p + z * q, w * s + x * r - y * q + z * p)

    return _let(F.struct(a.alias("a"), b.alias("b")), product)


def quat_from_euler(order: str, a: Column, b: Column, c: Column) -> Column:
    """Extrinsic turns about the named axes, in order, e.g. XYZ."""
    halves = {f"{f}{k}": turn(angle / 2) for k, angle in enumerate((a, b, c)) for f, turn in (("c", F.cos), ("s", F.sin))}

    def turned(p: Column) -> Column:
        """A turn about an axis has two parts only, so it adds two products a part; only the end is normalised."""
        out = {"w": F.lit(1.0), "x": F.lit(0.0), "y": F.lit(0.0), "z": F.lit(0.0)}
        for k, axis in enumerate(order.lower()):
            c, s = p[f"c{k}"], p[f"s{k}"]
            after, last = {"x": "yz", "y": "zx", "z": "xy"}[axis]
            if not k:
                out |= {"w": c, axis: s}
                continue
            out = {"w": c * out["w"] - s * out[axis], axis: c * out[axis] + s * out["w"], after: c * out[after] - s * out[last], last: c * out[last] + s * out[after]}
        return quat(*(out[k] for k in "wxyz"))

    if len(order) != 3:
        raise ValueError("order names three axes")
    return _let(_parts(**halves), turned)


def quat_inverse(q: Column) -> Column:
    return _let(q, lambda p: _parts(w=p["w"], x=-p["x"], y=-p["y"], z=-p["z"]))


def quat_magnitude(q: Column) -> Column:
    return _let(q, lambda p: 2 * F.atan2(F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"]), F.abs(p["w"])))


def quat_to_matrix(q: Column) -> Column:
    def rows(p: Column) -> Column:
        w, x, y, z = (p[c] for c in "wxyz")
        return F.array(
            F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)),
            F.array(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)),
            F.array(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)),
        )

    return _let(q, rows)


def quat_from_matrix(m: Column) -> Column:
    """From the largest of the four squared components, which keeps the division safe."""

    def pick(r: Column) -> Column:
        at = lambda i, j: r[i][j]
        t = at(0, 0) + at(1, 1) + at(2, 2)
        by_w = quat(1 + t, at(2, 1) - at(1, 2), at(0, 2) - at(2, 0), at(1, 0) - at(0, 1))
        by_x = quat(at(2, 1) - at(1, 2), 1 + 2 * at(0, 0) - t, at(0, 1) + at(1, 0), at(0, 2) + at(2, 0))
        by_y = quat(at(0, 2) - at(2, 0), at(0, 1) + at(1, 0), 1 + 2 * at(1, 1) - t, at(1, 2) + at(2, 1))
        by_z = quat(at(1, 0) - at(0, 1), at(0, 2) + at(2, 0), at(1, 2) + at(2, 1), 1 + 2 * at(2, 2) - t)
        most = F.greatest(t, at(0, 0), at(1, 1), at(2, 2))
        return F.when(most == t, by_w).when(most == at(0, 0), by_x).when(most == at(1, 1), by_y).otherwise(by_z)

    return _let(m, pick)


def quat_to_rotvec(q: Column) -> Column:
    def vector(p: Column) -> Column:
        s = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"] + p["z"] * p["z"])
        sign = F.when(p["w"] < 0, -1.0).otherwise(1.0)
        k = F.when(s > 0, 2 * F.atan2(s, F.abs(p["w"])) / s * sign).otherwise(2.0)
        return F.transform(F.array(p["x"], p["y"], p["z"]), lambda c: c * k)

    return _let(q, vector)


def rotate(q: Column, v: Column) -> Column:
    """The rotated array of three components."""
    return _let(
        F.struct(quat_to_matrix(q).alias("m"), v.alias("v")), lambda p: F.transform(p["m"], lambda row: row[0] * p["v"][0] + row[1] * p["v"][1] + row[2] * p["v"][2])
    )


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Along the shorter arc."""

    def between(p: Column) -> Column:
        near = p["angle"] < 1e-6
        u = F.when(near, 1 - p["t"]).otherwise(F.sin((1 - p["t"]) * p["angle"]) / F.sin(p["angle"]))
        w = F.when(near, p["t"]).otherwise(F.sin(p["t"] * p["angle"]) / F.sin(p["angle"])) * p["sign"]
        return quat(*(p["a"][c] * u + p["b"][c] * w for c in "wxyz"))

    def measured(p: Column) -> Column:
        d = p["a"]["w"] * p["b"]["w"] + p["a"]["x"] * p["b"]["x"] + p["a"]["y"] * p["b"]["y"] + p["a"]["z"] * p["b"]["z"]
        return F.struct(
            p["a"].alias("a"), p["b"].alias("b"), p["t"].alias("t"), F.when(d < 0, -1.0).otherwise(1.0).alias("sign"), F.acos(F.least(F.abs(d), F.lit(1.0))).alias("angle")
        )

    return _let(_let(F.struct(a.alias("a"), b.alias("b"), t.alias("t")), measured), between)


def quat_to_euler(q: Column, order: str = "XYZ") -> Column:
    """struct(a, b, c) of the angles that quat_from_euler takes, for XYZ and ZYX; b lies in [-pi/2, pi/2]."""
    m = quat_to_matrix(q)
    clip = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    if order == "XYZ":
        a, b, c = F.atan2(m[2][1], m[2][2]), F.asin(clip(-m[2][0])), F.atan2(m[1][0], m[0][0])
    elif order == "ZYX":
        a, b, c = F.atan2(-m[0][1], m[0][0]), F.asin(clip(m[0][2])), F.atan2(-m[1][2], m[2][2])
    else:
        raise ValueError("order is XYZ or ZYX")
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
