"""Transforms by two exchanges against plain ones."""

import numpy as np
import pyarrow as pa
import pytest

from sparksci.functions import windows
from sparksci.operators import fourier


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(fourier, "CHUNK", 32)  # many groups a series


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    return {"a": rng.normal(size=64), "b": rng.normal(size=37), "c": np.array([3.0]), "d": np.array([1.0, -2.0]), None: rng.normal(size=20)}


def table(spark, data):
    rows = [(k, 5 * i, float(v)) for k, x in data.items() for i, v in enumerate(x)] + [("a", None, 1.0), ("b", 3, None), ("void", 1, None)]
    return spark.createDataFrame(rows, "s string, t long, x double").repartition(3)


def spectra(out):
    got = {}
    for r in out.orderBy("pos").collect():
        got.setdefault(r["s"], []).append(complex(r["re"], r["im"]))
    return {k: np.array(v) for k, v in got.items()}


def test_power_of_two_transforms(spark, small):
    rng = np.random.default_rng(1)
    x = {n: rng.normal(size=n) + 1j * rng.normal(size=n) for n in (1, 2, 4, 8, 32, 128)}
    df = spark.createDataFrame([(str(n), n, i, float(v.real), float(v.imag)) for n, z in x.items() for i, v in enumerate(z)], "s string, size long, pos long, re double, im double")
    for inverse in (False, True):
        got = spectra(fourier.fft(df, "s", inverse))
        assert all(np.allclose(got[str(n)], np.fft.ifft(z) if inverse else np.fft.fft(z)) for n, z in x.items())
    sparse = spectra(fourier.fft(df.where("pos = 3"), "s"))  # positions without a row are 0
    assert set(sparse) == {"4", "8", "32", "128"} and len(sparse["128"]) == 128
    assert np.allclose(sparse["8"], x[8][3] * np.exp(-2j * np.pi * 3 * np.arange(8) / 8))


def test_transforms_of_any_length(spark, small, data):
    df = spark.createDataFrame([(k, len(x), i, float(v), 0.5) for k, x in data.items() for i, v in enumerate(x)], "s string, n long, pos long, re double, im double")
    for inverse in (False, True):
        got = spectra(fourier.dft(df, "s", inverse))
        for k, x in data.items():
            assert np.allclose(got[k], np.fft.ifft(x + 0.5j) if inverse else np.fft.fft(x + 0.5j))


def test_hilbert(spark, small, data):
    got = {}
    for r in fourier.hilbert(table(spark, data), "x", "t", "s").orderBy("t").collect():
        got.setdefault(r["s"], []).append(r)
    assert got.keys() == data.keys()
    for k, x in data.items():
        n = len(x)
        h = np.zeros(n)
        h[1 : n // 2], h[n // 2] = 2, 1 if n % 2 == 0 else 2
        h[0] = 1
        z = np.fft.ifft(np.fft.fft(x) * h)
        assert [r["t"] for r in got[k]] == [5 * i for i in range(n)]
        assert np.allclose([complex(r["re"], r["im"]) for r in got[k]], z)
        assert np.allclose([r["envelope"] for r in got[k]], np.abs(z))
        step = np.diff(np.angle(z), prepend=np.angle(z[0]))
        assert np.allclose(np.cos([r["frequency"] for r in got[k]]), np.cos(step)) and all(abs(r["frequency"]) <= np.pi + 1e-9 for r in got[k])
    sine = spark.createDataFrame([(i, float(np.sin(2 * np.pi * 5 * i / 256))) for i in range(256)], "t long, x double")
    assert all(abs(r["envelope"] - 1) < 1e-9 for r in fourier.hilbert(sine, "x", "t").collect())


@pytest.mark.parametrize(("num", "den"), [(2, 1), (3, 4)])
def test_resample(spark, small, data, num, den):
    got = {}
    for r in fourier.resample(table(spark, data), "x", "t", num, den, "s").orderBy("pos").collect():
        got.setdefault(r["s"], []).append(r["value"])
    for k, x in data.items():
        n, m = len(x), -(-len(x) * num // den)
        z, y = np.fft.fft(x), np.zeros(m, complex)
        for f in range(n):
            if f <= min(n, m) // 2 and f < m:
                y[f] = z[f]
            elif n - f <= (min(n, m) - 1) // 2:
                y[m - (n - f)] = z[f]
        assert np.allclose(got[k], np.fft.ifft(y).real * m / n), k
    t = np.arange(32)
    wave = spark.createDataFrame([(int(i), float(np.cos(2 * np.pi * 3 * i / 32))) for i in t], "t long, x double")
    up = [r["value"] for r in fourier.resample(wave, "x", "t", 5, 2).orderBy("pos").collect()]
    assert np.allclose(up, np.cos(2 * np.pi * 3 * np.arange(80) / 80))  # the wave at the new rate
    with pytest.raises(ValueError):
        fourier.resample(wave, "x", "t", 0, 2)


@pytest.mark.parametrize(("window", "detrend", "scaling", "onesided", "nfft"), [("rectangular", "constant", "density", True, None), ("hamming", "linear", "spectrum", False, 100)])
def test_periodogram(spark, small, data, window, detrend, scaling, onesided, nfft):
    got = {}
    for r in fourier.periodogram(table(spark, data), "x", "t", "s", 2.0, window, nfft, detrend, scaling, onesided).orderBy("bin").collect():
        got.setdefault(r["s"], []).append((r["freq"], r["psd"]))
    for k, x in data.items():
        n, i = len(x), np.arange(len(x))
        size = 1 << (max(n, nfft or 1) - 1).bit_length()
        v = x - x.mean() if detrend == "constant" else x if detrend == "none" else x - np.polyval(np.polyfit(i, x, 1), i) if n > 1 else x - x
        w = windows.samples(window, n, periodic=False)
        p = np.abs(np.fft.rfft(v * w, size)) ** 2 / ((2.0 if scaling == "density" else 1.0) * (w**2).sum())
        if onesided and len(p) > 2:
            p[1:-1] *= 2
        assert len(got[k]) == size // 2 + 1
        if n > 2 or window == "rectangular":
            assert np.allclose([b for _, b in got[k]], p, atol=1e-9), k
        assert np.allclose([a for a, _ in got[k]], np.arange(size // 2 + 1) * 2.0 / size)
    flat = spark.createDataFrame([(i, 1.0) for i in range(256)], "t long, x double")
    psd = [r["psd"] for r in fourier.periodogram(flat, "x", "t", window="rectangular", detrend="none").orderBy("bin").collect()]
    assert psd[0] > 100 and max(psd[1:]) < 1e-9


def test_no_rows(spark):
    none = spark.createDataFrame([], "s string, t long, x double")
    assert fourier.hilbert(none, "x", "t", "s").count() == 0 and fourier.periodogram(none, "x", "t", "s").count() == 0 and fourier.resample(none, "x", "t", 2, 1, "s").count() == 0


def test_a_task_holds_few_results_at_once():
    """However many series a batch brings, they are taken in pieces of about PIECE values."""
    sizes = [1 << 14] * 100 + [1 << 30] * 3 + [1] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(range(len(sizes)))], ["size", "row"])
    pieces = list(fourier._pieces([batch, batch.slice(0, 0)]))
    assert [r for p in pieces for r in p.column("row").to_pylist()] == list(range(len(sizes)))
    most = [sum(min(n, fourier.CHUNK) for n in p.column("size").to_pylist()) for p in pieces]
    assert len(pieces) > 5 and max(most) <= 2 * fourier.PIECE


def test_series_that_are_known_are_not_computed_again(spark):
    """With its sizes given, a transform reads its rows once."""
    sc = spark.sparkContext
    seen = sc.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(64).selectExpr("64L AS size", "id AS pos", "double(id) AS re", "0d AS im").mapInArrow(count, "size long, pos long, re double, im double")
    known = spark.range(1).selectExpr("64L AS size")
    got = {r["pos"]: complex(r["re"], r["im"]) for r in fourier.fft(rows, sizes=known).collect()}
    assert np.allclose([got[k] for k in range(64)], np.fft.fft(np.arange(64)))
    assert seen.value == 64
