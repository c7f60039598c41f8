"""Silhouettes against the definition, over several blocks."""

import random

import numpy as np
import pytest

from sparksci.operators import cluster


def test_silhouettes_over_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 8)
    rng = random.Random(4)
    x = [[rng.gauss(c % 3, 1) for _ in range(5)] for c in range(30)]
    x = np.array(x + [x[3]] * 3)
    label = np.arange(len(x)) % 3
    label[-1] = 7  # alone with its label
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))]
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    want = {}
    for i, k in enumerate(label):
        own = (label == k).sum()
        a = d[i, label == k].sum() / (own - 1) if own > 1 else 0.0
        b = min(d[i, label == o].mean() for o in np.unique(label) if o != k)
        want[i] = (b - a) / max(a, b, 1e-10)
    for sums in (1, 1 << 21):  # given on after every pair of blocks, and once
        monkeypatch.setattr(cluster, "SUMS", sums)
        got = {r["id"]: r["silhouette"] for r in cluster.silhouette_samples(spark.createDataFrame(rows, "id long, v array<double>, label long")).collect()}
        assert got == pytest.approx(want)


def test_a_task_adds_up_its_blocks():
    import pandas as pd

    x = np.arange(6.0).reshape(3, 2)
    row = {"block": 0, "ids": np.arange(3), "labels": np.zeros(3, int), "v": x.tobytes(), "labels2": np.zeros(3, int), "v2": x.tobytes()}
    parts = pd.concat(cluster._label_sums(iter([pd.DataFrame([row] * 4)])))
    assert len(parts) == 3 and set(parts["n"]) == {12}
