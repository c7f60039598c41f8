"""Scanned filters against the recursion sample by sample."""

import numpy as np
import pytest

from sparksci.operators import filters


def by_hand(b, a, x):
    b, a = filters.coefficients(b, a)
    z, out = np.zeros(len(b) - 1), []
    for v in x:
        y = b[0] * v + z[0]
        z = np.append(z[1:], 0) + b[1:] * v - a[1:] * y
        out.append(y)
    return np.array(out)


def extended(x, pad, kind):
    if kind == "none":
        return x
    left, right = x[pad:0:-1], x[-2 : -pad - 2 : -1]
    if kind == "odd":
        left, right = 2 * x[0] - left, 2 * x[-1] - right
    if kind == "constant":
        left, right = np.full(pad, x[0]), np.full(pad, x[-1])
    return np.concatenate([left, x, right])


def two_ways(run, x, pad, kind):
    y = run(run(extended(x, pad, kind))[::-1])[::-1]
    return y if kind == "none" else y[pad : pad + len(x)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    return {"long": rng.normal(size=203), "one": np.array([2.0]), "short": rng.normal(size=11), None: rng.normal(size=64)}


@pytest.fixture
def df(spark, data, monkeypatch):
    monkeypatch.setattr(filters, "BLOCK", 16)  # many blocks a series
    rows = [(k, i * 3, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("long", None, 1.0), ("long", 999, None), ("void", 1, None)]
    return spark.createDataFrame(rows, "s string, t long, x double").repartition(3)


def read(out):
    got = {}
    for r in out.orderBy("t").collect():
        got.setdefault(r["s"], []).append((r["t"], r["y"]))
    return got


def same(got, want):
    assert got.keys() == want.keys()
    for k, y in want.items():
        assert [t for t, _ in got[k]] == [3 * i for i in range(len(y))]
        assert np.allclose([v for _, v in got[k]], y)


B, A = [0.2, 0.3], [2.0, -1.0, 0.2]
SOS = [[0.25, 0.5, 0.25, 1, -0.4, 0.1], [0.5, 0.2, 0, 2, -0.6, 0.2]]


def test_filters_equal_the_recursion(spark, df, data):
    same(read(filters.lfilter(df, "x", "t", B, A, "s")), {k: by_hand(B, A, x) for k, x in data.items()})
    same(read(filters.lfilter(df, "x", "t", [0.25] * 4, [1.0], "s")), {k: by_hand([0.25] * 4, [1.0], x) for k, x in data.items()})
    cascade = lambda x: by_hand(SOS[1][:3], SOS[1][3:], by_hand(SOS[0][:3], SOS[0][3:], x))
    same(read(filters.sosfilt(df, "x", "t", SOS, "s")), {k: cascade(x) for k, x in data.items()})
    same(read(filters.sosfilt(df, "x", "t", [], "s")), data)
    whole = [r["y"] for r in filters.lfilter(df.where("s = 'long'"), "x", "t", B, A).orderBy("t").collect()]
    assert np.allclose(whole, by_hand(B, A, data["long"]))


@pytest.mark.parametrize("kind", filters.PADS)
def test_both_ways_equal_two_recursions(df, data, kind):
    want = {k: two_ways(lambda v: by_hand(B, A, v), x, 9, kind) for k, x in data.items() if len(x) > 9}
    same(read(filters.filtfilt(df, "x", "t", B, A, "s", kind)), want)


def test_sections_both_ways(df, data):
    cascade = lambda x: by_hand(SOS[1][:3], SOS[1][3:], by_hand(SOS[0][:3], SOS[0][3:], x))
    same(read(filters.sosfiltfilt(df, "x", "t", SOS, "s")), {k: two_ways(cascade, x, 12, "odd") for k, x in data.items() if len(x) > 12})


def test_wrong_filters(df):
    with pytest.raises(ValueError):
        filters.lfilter(df, "x", "t", B, [0.0, 1.0], "s")
    with pytest.raises(ValueError):
        filters.filtfilt(df, "x", "t", B, A, "s", "wrap")
    assert filters.filtfilt(df.where("s = 'void'"), "x", "t", B, A, "s").count() == 0
