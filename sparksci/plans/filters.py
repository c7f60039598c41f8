"""Recursive filters over events: one long series a type, many short ones a user."""

from __future__ import annotations

from sparksci.operators import filters as R
from sparksci.plans.registry import query, r
from sparksci.plans.statistics import events

B, A = [0.2113, 0.3071], [1.0, -0.5237, 0.1093]
SECTIONS = [[0.2513, 0.4871, 0.2239, 1.0, -0.3947, 0.1123], [0.5171, 0.2083, 0.0, 2.0, -0.6137, 0.2311]]


def recursion(source: str, name: str, key: str, b: list[float], a: list[float]) -> str:
    """CTEs: the filter of table ``source`` (key, i, x), sample by sample, as table ``name`` (key, i, y)."""
    b, a = ([c / a[0] for c in v] + [0.0] * (3 - len(v)) for v in (b, a))
    return f"""{name}_r AS (WITH RECURSIVE f({key}, i, y, z0, z1) AS (
  SELECT {key}, i, {b[0]}::DOUBLE * x, {b[1]}::DOUBLE * x - {a[1]}::DOUBLE * ({b[0]}::DOUBLE * x), {b[2]}::DOUBLE * x - {a[2]}::DOUBLE * ({b[0]}::DOUBLE * x) FROM {source} WHERE i = 0
  UNION ALL SELECT s.{key}, s.i, {b[0]}::DOUBLE * s.x + z0, {b[1]}::DOUBLE * s.x - {a[1]}::DOUBLE * ({b[0]}::DOUBLE * s.x + z0) + z1, {b[2]}::DOUBLE * s.x - {a[2]}::DOUBLE * ({b[0]}::DOUBLE * s.x + z0)
  FROM f JOIN {source} s ON s.{key} = f.{key} AND s.i = f.i + 1) SELECT {key}, i, y FROM f), {name} AS (SELECT {key}, i, y AS x FROM {name}_r)"""


def series(key: str) -> str:
    return f"WITH s AS (SELECT {key}, event_id, row_number() OVER (PARTITION BY {key} ORDER BY event_id) - 1 AS i, value AS x, count(*) OVER (PARTITION BY {key}) AS n FROM events), "


def padded(key: str, pad: int) -> str:
    """CTE p (key, i, x): odd extension by ``pad`` values at both ends."""
    return f"""e AS (SELECT {key}, n, max(CASE WHEN i = 0 THEN x END) AS f, max(CASE WHEN i = n - 1 THEN x END) AS l FROM s GROUP BY 1, 2),
p AS (SELECT {key}, i + {pad} AS i, x FROM s WHERE n > {pad}
UNION ALL SELECT s.{key}, {pad} - i, 2 * f - x FROM s JOIN e ON e.{key} = s.{key} WHERE s.n > {pad} AND i BETWEEN 1 AND {pad}
UNION ALL SELECT s.{key}, {pad} + 2 * (s.n - 1) - i, 2 * l - x FROM s JOIN e ON e.{key} = s.{key} WHERE s.n > {pad} AND s.n - 1 - i BETWEEN 1 AND {pad})"""


def turned(source: str, name: str, key: str, pad: int) -> str:
    return f"{name} AS (SELECT q.{key}, e.n + {2 * pad} - 1 - i AS i, x FROM {source} q JOIN e ON e.{key} = q.{key})"


@query("lfilter", series("event_type") + recursion("s", "y", "event_type", B, A) + f" SELECT s.event_type, event_id, {r('y.x', 'y')} FROM s JOIN y ON y.event_type = s.event_type AND y.i = s.i")
def _(spark, d):
    return R.lfilter(events(spark, d), "value", "event_id", B, A, "event_type")


def cascade(first: str, key: str, names: tuple[str, str]) -> str:
    return ", ".join(recursion(source, name, key, s[:3], s[3:]) for source, name, s in zip((first, names[0]), names, SECTIONS, strict=True))


@query("sosfilt", series("user_id") + cascade("s", "user_id", ("y", "w")) + f" SELECT s.user_id, event_id, {r('w.x', 'y')} FROM s JOIN w ON w.user_id = s.user_id AND w.i = s.i")
def _(spark, d):
    return R.sosfilt(events(spark, d), "value", "event_id", SECTIONS, "user_id")


@query(
    "filtfilt",
    ", ".join([series("user_id").removesuffix(", "), padded("user_id", 9), recursion("p", "y", "user_id", B, A), turned("y", "t", "user_id", 9), recursion("t", "z", "user_id", B, A), turned("z", "o", "user_id", 9)])
    + f" SELECT s.user_id, event_id, {r('o.x', 'y')} FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 9",
)
def _(spark, d):
    return R.filtfilt(events(spark, d), "value", "event_id", B, A, "user_id")


@query(
    "sosfiltfilt",
    ", ".join([series("user_id").removesuffix(", "), padded("user_id", 12), cascade("p", "user_id", ("y", "y2")), turned("y2", "t", "user_id", 12), cascade("t", "user_id", ("z", "z2")), turned("z2", "o", "user_id", 12)])
    + f" SELECT s.user_id, event_id, {r('o.x', 'y')} FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 12",
)
def _(spark, d):
    return R.sosfiltfilt(events(spark, d), "value", "event_id", SECTIONS, "user_id")
