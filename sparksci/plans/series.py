"""Series operators and interpolation: each user's events are a series, in order of event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparksci.operators import fourier
from sparksci.operators import interpolate as P
from sparksci.operators import series as S
from sparksci.plans.registry import query, r
from sparksci.plans.statistics import events

W = "WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"
KEY = ["user_id", "event_id"]


def lines(spark, d):
    return events(spark, d).select(*KEY, "value", F.col("event_id").cast("double").alias("x"))


@query(
    "trapezoid",
    f"""WITH p AS (SELECT user_id, (value + lag(value) OVER w) / 2 * (event_id - lag(event_id) OVER w) AS a FROM events {W})
SELECT user_id, {r('coalesce(sum(a), 0)', 'integral')} FROM p GROUP BY 1""",
)
def _(spark, d):
    return S.trapezoid(lines(spark, d), "value", "x", "user_id")


@query(
    "cumulative_trapezoid",
    f"""WITH p AS (SELECT user_id, event_id, coalesce((value + lag(value) OVER w) / 2 * (event_id - lag(event_id) OVER w), 0) AS a FROM events {W})
SELECT user_id, event_id, {r('sum(a) OVER w', 'cumulative')} FROM p {W}""",
)
def _(spark, d):
    return S.cumulative_trapezoid(lines(spark, d), "value", "x", "user_id").select(*KEY, "cumulative")


@query(
    "simpson",
    f"""WITH p AS (SELECT user_id, event_id::DOUBLE AS x0, value AS y0, row_number() OVER w AS i, lead(event_id, 1) OVER w AS x1, lead(event_id, 2) OVER w AS x2,
lead(value, 1) OVER w AS y1, lead(value, 2) OVER w AS y2 FROM events {W}), h AS (SELECT *, x1 - x0 AS a, x2 - x1 AS b FROM p)
SELECT user_id, {r('''coalesce(sum(CASE WHEN i % 2 = 1 THEN CASE WHEN x2 IS NOT NULL THEN (a + b) / 6 * ((2 - b / a) * y0 + pow(a + b, 2) / (a * b) * y1 + (2 - a / b) * y2)
WHEN x1 IS NOT NULL THEN (y0 + y1) / 2 * a END END), 0)''', 'integral')} FROM h GROUP BY 1""",
)
def _(spark, d):
    return S.simpson(lines(spark, d), "value", "x", "user_id")


@query(
    "medfilt",
    f"""WITH n AS (SELECT user_id, event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS near FROM events)
SELECT user_id, event_id, {r('near[len(near) // 2 + 1]', 'medfilt')} FROM n""",
)
def _(spark, d):
    return S.medfilt(lines(spark, d), "value", "event_id", "user_id", 3).select(*KEY, "medfilt")


@query(
    "wiener",
    f"""WITH a AS (SELECT user_id, event_id, value AS y, avg(value) OVER f AS m, var_pop(value) OVER f AS v FROM events
WINDOW f AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, greatest(min(v) OVER (PARTITION BY user_id), 1e-10) AS n FROM a)
SELECT user_id, event_id, {r('m + greatest(v - n, 0) / greatest(v, n) * (y - m)', 'wiener')} FROM b""",
)
def _(spark, d):
    return S.wiener(lines(spark, d), "value", "event_id", "user_id", 3).select(*KEY, "wiener")


for name, agg in (("minimum_filter", "min"), ("maximum_filter", "max")):

    @query(
        name,
        f"""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
{r(f'{agg}(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 'value')} FROM events""",
    )
    def _(spark, d, name=name):
        return getattr(S, name)(lines(spark, d), "value", "event_id", "user_id", 3)


AROUND = """WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, value AS y, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER w AS y0,
last_value(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y9,
lag(value) OVER w AS a, lead(value) OVER w AS b FROM events """ + W + ") "


@query("uniform_filter", AROUND + f"SELECT user_id, pos, {r('(coalesce(a, y0) + y + coalesce(b, y9)) / 3', 'value')} FROM s")
def _(spark, d):
    return S.uniform_filter(lines(spark, d), "value", "event_id", "user_id", 3, "nearest")


@query("gaussian_filter", AROUND + f"SELECT user_id, pos, {r('(coalesce(a, y0) * exp(-2) + y + coalesce(b, y9) * exp(-2)) / (1 + 2 * exp(-2))', 'value')} FROM s")
def _(spark, d):
    return S.gaussian_filter(lines(spark, d), "value", "event_id", "user_id", 0.5, 0, "nearest", 2.0)


@query(
    "percentile_filter",
    AROUND + f"SELECT user_id, pos, {r('list_sort([coalesce(a, y0), y, coalesce(b, y9)])[2]', 'value')} FROM s",
)
def _(spark, d):
    return S.percentile_filter(lines(spark, d), "value", "event_id", 50, "user_id", 3, "nearest")


@query("savgol_filter")
def _(spark, d):
    return S.savgol_filter(lines(spark, d), "value", "event_id", "user_id", 5, 2)


FULL = """WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events """ + W + """),
kern(j, c) AS (VALUES (0, 1.0), (1, 0.5), (2, -1.0)), f AS (SELECT user_id, i + j AS k, sum(y * c::DOUBLE) AS value, max(n) AS n FROM s, kern GROUP BY 1, 2) """


@query("convolve_full", FULL + f"SELECT user_id, k AS pos, {r('value', 'value')} FROM f")
def _(spark, d):
    return S.convolve(lines(spark, d), "value", "event_id", [1.0, 0.5, -1.0], "user_id")


@query("convolve_same", FULL + f", o AS (SELECT *, greatest(n, 3) AS size, floor((n + 2 - greatest(n, 3)) / 2)::BIGINT AS first FROM f) SELECT user_id, k - first AS pos, {r('value', 'value')} FROM o WHERE k >= first AND k < first + size")
def _(spark, d):
    return S.convolve(lines(spark, d), "value", "event_id", [1.0, 0.5, -1.0], "user_id", "same")


@query("correlate", FULL.replace("(0, 1.0), (1, 0.5), (2, -1.0)", "(0, -1.0), (1, 0.5), (2, 1.0)") + f"SELECT user_id, k AS pos, {r('value', 'value')} FROM f")
def _(spark, d):
    return S.correlate(lines(spark, d), "value", "event_id", [1.0, 0.5, -1.0], "user_id")


for kind, op in (("min", "<"), ("max", ">")):

    @query(
        f"argrel{kind}",
        f"""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events {W})
SELECT user_id, pos, round(value, 4) + 0.0 AS value FROM s WHERE (a IS NULL OR value {op} a) AND (b IS NULL OR value {op} b)""",
    )
    def _(spark, d, kind=kind):
        return S.argrel(lines(spark, d), "value", "event_id", "user_id", kind).select("user_id", "pos", "value")


@query(
    "find_peaks",
    f"""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS pos, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events {W})
SELECT user_id, pos, round(value, 4) + 0.0 AS value FROM s WHERE value > a AND value > b AND value >= 20 AND least(value - a, value - b) >= 2""",
)
def _(spark, d):
    return S.find_peaks(lines(spark, d), "value", "event_id", "user_id", 20, 2).select("user_id", "pos", "value")


@query("decimate", f"WITH s AS (SELECT user_id, event_id, row_number() OVER w - 1 AS i FROM events {W}) SELECT user_id, event_id FROM s WHERE i % 2 = 0")
def _(spark, d):
    return S.decimate(lines(spark, d), "event_id", 2, "user_id").select(*KEY)


@query(
    "haar_dwt",
    f"""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS y FROM events {W}),
p AS (SELECT user_id, i // 2 AS pos, max(CASE WHEN i % 2 = 0 THEN y END) AS a, coalesce(max(CASE WHEN i % 2 = 1 THEN y END), max(CASE WHEN i % 2 = 0 THEN y END)) AS b FROM s GROUP BY 1, 2)
SELECT user_id, pos, {r('(a + b) / sqrt(2)', 'approx')}, {r('(a - b) / sqrt(2)', 'detail')} FROM p""",
)
def _(spark, d):
    return S.haar_dwt(lines(spark, d), "value", "event_id", "user_id")


# One level of the Haar transform with zeros beyond the ends: value i of a series is in pair (i + 1) // 2.
HAAR = "sum({y}) / sqrt(2) AS a, sum(CASE WHEN (i + 1) % 2 = 0 THEN {y} ELSE -{y} END) / sqrt(2) AS d"


@query(
    "wavedec",
    f"""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS y FROM events {W}),
one AS (SELECT user_id, (i + 1) // 2 AS i, {HAAR.format(y='y')} FROM s GROUP BY user_id, (i + 1) // 2),
two AS (SELECT user_id, (i + 1) // 2 AS i, {HAAR.format(y='a')} FROM (SELECT user_id, i, a FROM one) GROUP BY user_id, (i + 1) // 2)
SELECT user_id, 1 AS level, 'detail' AS part, i AS pos, {r('d', 'value')} FROM one
UNION ALL SELECT user_id, 2, 'detail', i, {r('d', 'value')} FROM two
UNION ALL SELECT user_id, 2, 'approx', i, {r('a', 'value')} FROM two""",
)
def _(spark, d):
    return S.wavedec(lines(spark, d), "value", "event_id", "user_id", extension="zero", level=2)


@query(
    "idwt",
    f"""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS i, value AS y FROM events {W}),
one AS (SELECT user_id, (i + 1) // 2 AS p, {HAAR.format(y='y')} FROM s GROUP BY user_id, (i + 1) // 2),
v AS (SELECT user_id, 2 * p AS pos, (a + d) / sqrt(2) AS value FROM one UNION ALL SELECT user_id, 2 * p + 1, (a - d) / sqrt(2) FROM one
UNION ALL SELECT user_id, 2 * max(p) + 2, 0.0 FROM one GROUP BY user_id)
SELECT user_id, pos, {r('value', 'value')} FROM v""",
)
def _(spark, d):
    return S.idwt(S.dwt(lines(spark, d), "value", "event_id", "user_id", extension="zero"), "user_id", extension="zero")


@query(
    "detrend_linear",
    f"""WITH s AS (SELECT user_id, event_id, value AS y, (row_number() OVER w - 1)::DOUBLE AS i FROM events {W}),
f AS (SELECT user_id, avg(y) AS m, avg(i) AS c, CASE WHEN count(*) > 1 THEN regr_slope(y, i) ELSE 0 END AS b FROM s GROUP BY 1)
SELECT s.user_id, event_id, {r('y - (m + b * (i - c))', 'detrended')} FROM s JOIN f ON s.user_id = f.user_id""",
)
def _(spark, d):
    return S.detrend(lines(spark, d), "value", "event_id", "user_id").select(*KEY, "detrended")


@query(
    "lombscargle",
    """WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), q(freq) AS (VALUES (0.5), (1.0), (2.0)),
s AS (SELECT e.event_type, value - m AS v, (user_id % 97)::DOUBLE AS t FROM events e JOIN m ON e.event_type = m.event_type),
a AS (SELECT event_type, freq::DOUBLE AS w, atan2(sum(sin(2 * freq * t)), sum(cos(2 * freq * t))) / 2 AS tau FROM s, q GROUP BY event_type, freq)
SELECT s.event_type, w AS freq, round(0.5 * (pow(sum(v * cos(w * t - tau)), 2) / sum(pow(cos(w * t - tau), 2)) + pow(sum(v * sin(w * t - tau)), 2) / sum(pow(sin(w * t - tau), 2))), 4) + 0.0 AS power
FROM s JOIN a ON s.event_type = a.event_type GROUP BY s.event_type, w""",
)
def _(spark, d):
    rows = events(spark, d).withColumn("t", (F.col("user_id") % 97).cast("double"))
    return S.lombscargle(rows, "value", "t", [0.5, 1.0, 2.0], "event_type")


@query("welch")
def _(spark, d):
    return S.welch(events(spark, d), "value", "event_id", "event_type", nperseg=64)


@query("stft")
def _(spark, d):
    return S.stft(events(spark, d), "value", "event_id", "event_type", 64)


@query("spectrogram")
def _(spark, d):
    return S.spectrogram(events(spark, d), "value", "event_id", "event_type", 64)


KNOTS = "WITH k AS (SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events), q AS (SELECT user_id, event_id, event_id + 0.3 AS xq FROM events), n AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lag(x) OVER w AS xp, lag(y) OVER w AS yp FROM k WINDOW w AS (PARTITION BY user_id ORDER BY x)) "


def _queries(spark, d):
    return lines(spark, d), events(spark, d).select(*KEY, (F.col("event_id") + 0.3).alias("xq"))


@query(
    "interp1d_linear",
    KNOTS
    + f"""SELECT q.user_id, event_id, {r('''CASE WHEN x1 IS NOT NULL THEN y + (y1 - y) * (xq - x) / (x1 - x) WHEN xp IS NOT NULL THEN yp + (y - yp) * (xq - xp) / (x - xp) ELSE y END''', 'value')}
FROM q JOIN n ON q.user_id = n.user_id AND q.event_id = n.x""",
)
def _(spark, d):
    k, q = _queries(spark, d)
    return P.interp1d(k, q, "x", "value", "xq", "user_id").select(*KEY, "value")


@query("interp1d_nearest", f"SELECT user_id, event_id, {r('value', 'value')} FROM events")
def _(spark, d):
    k, q = _queries(spark, d)
    return P.interp1d(k, q, "x", "value", "xq", "user_id", "nearest").select(*KEY, "value")


@query("pchip_slopes")
def _(spark, d):
    return P.pchip_slopes(lines(spark, d), "x", "value", "user_id").select(*KEY, "slope")


@query("akima_slopes")
def _(spark, d):
    return P.akima_slopes(lines(spark, d), "x", "value", "user_id").select(*KEY, "slope")


@query("pchip_interpolate")
def _(spark, d):
    k, q = _queries(spark, d)
    return P.hermite(P.pchip_slopes(k, "x", "value", "user_id"), q, "x", "value", "slope", "xq", "user_id").select(*KEY, "value")


# A type's events are one long series: freed from the mean, weighed by a symmetric Hann window, filled up to a power of two.
@query(
    "periodogram",
    f"""WITH o AS (SELECT event_type, value - avg(value) OVER (PARTITION BY event_type) AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
v AS (SELECT event_type, i, y * w AS y, w, pow(2, ceil(log2(n)))::BIGINT AS size FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) AS w FROM o)),
b AS (SELECT event_type, size, sum(w * w) AS w, unnest(range(size // 2 + 1)) AS bin FROM v GROUP BY 1, 2),
s AS (SELECT b.event_type, b.size, b.w, b.bin, sum(y * cos(2 * pi() * ((b.bin * i) % b.size) / b.size)) AS re, sum(y * sin(2 * pi() * ((b.bin * i) % b.size) / b.size)) AS im FROM v JOIN b ON b.event_type = v.event_type GROUP BY 1, 2, 3, 4)
SELECT event_type, bin, {r('bin / size', 'freq')}, {r('CASE WHEN bin = 0 OR 2 * bin = size THEN 1.0 ELSE 2.0 END * (re * re + im * im) / w', 'psd')} FROM s""",
)
def _(spark, d):
    return fourier.periodogram(events(spark, d), "value", "event_id", "event_type")


# Both ways of a plain transform, term by term.
SPECTRUM = """WITH o AS (SELECT user_id, event_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT o.user_id, o.n, k.i AS k, sum(o.y * cos(2 * pi() * ((k.i * o.i) % o.n) / o.n)) AS re, -sum(o.y * sin(2 * pi() * ((k.i * o.i) % o.n) / o.n)) AS im FROM o JOIN o k ON k.user_id = o.user_id GROUP BY 1, 2, 3), """


@query(
    "hilbert",
    SPECTRUM
    + f"""h AS (SELECT *, CASE WHEN k = 0 THEN 1 WHEN k < n // 2 THEN 2 WHEN k > n // 2 THEN 0 WHEN n % 2 = 0 THEN 1 ELSE 2 END AS h FROM s),
z AS (SELECT o.user_id, o.event_id, sum(h * (re * cos(2 * pi() * ((k * i) % o.n) / o.n) - im * sin(2 * pi() * ((k * i) % o.n) / o.n))) / any_value(o.n) AS re, sum(h * (re * sin(2 * pi() * ((k * i) % o.n) / o.n) + im * cos(2 * pi() * ((k * i) % o.n) / o.n))) / any_value(o.n) AS im FROM o JOIN h ON h.user_id = o.user_id GROUP BY 1, 2)
SELECT user_id, event_id, {r('re', 're')}, {r('im', 'im')}, {r('sqrt(re * re + im * im)', 'envelope')} FROM z""",
)
def _(spark, d):
    return fourier.hilbert(events(spark, d), "value", "event_id", "user_id").select("user_id", "event_id", "re", "im", "envelope")


@query(
    "resample",
    SPECTRUM
    + f"""t AS (SELECT *, ((3 * n + 1) // 2)::BIGINT AS m FROM s), y AS (SELECT user_id, n, m, re, im, CASE WHEN k <= n // 2 THEN k ELSE m - (n - k) END AS k FROM t),
q AS (SELECT DISTINCT user_id, m, unnest(range(m)) AS pos FROM y)
SELECT y.user_id, q.pos, {r('sum(re * cos(2 * pi() * ((k * pos) % y.m) / y.m) - im * sin(2 * pi() * ((k * pos) % y.m) / y.m)) / any_value(n)', 'value')} FROM y JOIN q ON q.user_id = y.user_id GROUP BY 1, 2""",
)
def _(spark, d):
    return fourier.resample(events(spark, d), "value", "event_id", 3, 2, "user_id")


@query("csd")
def _(spark, d):
    return S.csd(events(spark, d).withColumn("u", F.col("user_id").cast("double")), "value", "u", "event_id", "event_type", nperseg=64)


@query("coherence")
def _(spark, d):
    return S.coherence(events(spark, d).withColumn("u", F.col("user_id").cast("double")), "value", "u", "event_id", "event_type", nperseg=64)


@query(
    "istft",
    f"""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, i, {r('value', 'value')} FROM o WHERE i > 0 AND i < (n - 64) // 16 * 16 + 64""",
)
def _(spark, d):
    return S.istft(S.stft(events(spark, d), "value", "event_id", "event_type", 64), "event_type", 64)


SPLINE = """WITH RECURSIVE k AS (SELECT user_id, event_id::DOUBLE AS x, value AS y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n,
  event_id - lag(event_id) OVER w AS h, lead(event_id) OVER w - event_id AS g, value - lag(value) OVER w AS u, lead(value) OVER w - value AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS ({system}),
f AS (SELECT user_id, i, up / mid AS p, rhs / mid AS s, stop FROM q WHERE i = start UNION ALL
  SELECT q.user_id, q.i, q.up / (q.mid - q.lo * f.p), (q.rhs - q.lo * f.s) / (q.mid - q.lo * f.p), f.stop FROM f JOIN q ON q.user_id = f.user_id AND q.i = f.i + 1),
z AS (SELECT user_id, i, s AS m FROM f WHERE i = stop UNION ALL SELECT f.user_id, f.i, f.s - f.p * z.m FROM z JOIN f ON f.user_id = z.user_id AND f.i = z.i - 1),
m AS (SELECT * FROM z {ends}) """
SPLINES = {
    "natural": SPLINE.format(
        system="""SELECT user_id, i, 0 AS start, n - 1 AS stop, CASE WHEN i IN (0, n - 1) THEN 0 ELSE h END AS lo, CASE WHEN i IN (0, n - 1) THEN 1 ELSE 2 * (h + g) END AS mid,
  CASE WHEN i IN (0, n - 1) THEN 0 ELSE g END AS up, CASE WHEN i IN (0, n - 1) THEN 0 ELSE 6 * (v / g - u / h) END AS rhs FROM k""",
        ends="",
    ),
    "not-a-knot": SPLINE.format(
        system="""SELECT user_id, i, 1 AS start, n - 2 AS stop, CASE WHEN i = 1 THEN 0 WHEN i = n - 2 THEN (h * h - g * g) / h ELSE h END AS lo,
  CASE WHEN n = 3 THEN 3 * (h + g) WHEN i = 1 THEN (h + g) * (h + 2 * g) / g WHEN i = n - 2 THEN (h + g) * (g + 2 * h) / h ELSE 2 * (h + g) END AS mid,
  CASE WHEN i = n - 2 THEN 0 WHEN i = 1 THEN (g * g - h * h) / g ELSE g END AS up, 6 * (v / g - u / h) AS rhs FROM k WHERE i BETWEEN 1 AND n - 2""",
        ends="""UNION ALL SELECT user_id, 0, CASE WHEN n = 3 THEN a.m ELSE ((h + g) * a.m - h * b.m) / g END FROM k JOIN z a USING (user_id, i) LEFT JOIN z b ON b.user_id = k.user_id AND b.i = 2 WHERE k.i = 1
UNION ALL SELECT user_id, n - 1, CASE WHEN n = 3 THEN a.m ELSE ((h + g) * a.m - g * b.m) / h END FROM k JOIN z a USING (user_id, i) LEFT JOIN z b ON b.user_id = k.user_id AND b.i = n - 3 WHERE k.i = n - 2
UNION ALL SELECT user_id, i, 0 FROM k WHERE n = 2""",
    ),
}
SEGMENTS = f"""SELECT k.user_id, k.i AS segment, {r('x', 'x0')}, {r('y', 'a')}, {r('v / g - g * (2 * m.m + o.m) / 6', 'b')}, {r('m.m / 2', 'c')}, {r('(o.m - m.m) / (6 * g)', 'd')}
FROM k JOIN m ON m.user_id = k.user_id AND m.i = k.i JOIN m o ON o.user_id = k.user_id AND o.i = k.i + 1"""


@query("cubic_spline_coefficients", SPLINES["natural"] + SEGMENTS)
def _(spark, d):
    return P.cubic_spline_coefficients(lines(spark, d), "x", "value", "user_id")


@query("cubic_spline_not_a_knot", SPLINES["not-a-knot"] + SEGMENTS)
def _(spark, d):
    return P.cubic_spline_coefficients(lines(spark, d), "x", "value", "user_id", "not-a-knot")


DRAWN = "CASE WHEN h = 0 THEN ya ELSE ya + (xq - a) * ma + (xq - a) ** 2 * (3 * k - 2 * ma - mb) / h + (xq - a) ** 3 * (ma + mb - 2 * k) / h ** 2 END"


@query(
    "interp1d_cubic",
    KNOTS
    + f""", s AS (SELECT *, (y1 - y) / (x1 - x) AS e, (y - yp) / (x - xp) AS b FROM n),
t AS (SELECT user_id, x, y, coalesce((coalesce(e, b) + coalesce(b, e)) / 2, 0) AS m FROM s),
p AS (SELECT t.*, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(m) OVER w AS m1, lag(x) OVER w AS xp, lag(y) OVER w AS yp, lag(m) OVER w AS mp FROM t WINDOW w AS (PARTITION BY user_id ORDER BY x)),
o AS (SELECT q.user_id, event_id, xq, CASE WHEN x1 IS NULL THEN coalesce(xp, x) ELSE x END AS a, CASE WHEN x1 IS NULL THEN coalesce(yp, y) ELSE y END AS ya, CASE WHEN x1 IS NULL THEN coalesce(mp, m) ELSE m END AS ma,
  coalesce(CASE WHEN x1 IS NULL THEN x ELSE x1 END, x) AS b, coalesce(y1, y) AS yb, coalesce(m1, m) AS mb FROM q JOIN p ON q.user_id = p.user_id AND q.event_id = p.x),
u AS (SELECT *, b - a AS h, CASE WHEN a = b THEN 0 ELSE (yb - ya) / (b - a) END AS k FROM o)
SELECT user_id, event_id, {r(DRAWN, 'value')} FROM u""",
)
def _(spark, d):
    k, q = _queries(spark, d)
    return P.interp1d(k, q, "x", "value", "xq", "user_id", "cubic").select(*KEY, "value")
