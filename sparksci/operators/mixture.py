"""Gaussian mixtures by expectation-maximisation: each pass sums sufficient statistics in the tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("full", "tied", "diagonal", "spherical")


@dataclass(frozen=True)
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str = "full"
    log_likelihood: float = float("nan")
    iterations: int = 0

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density for each row and component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            out[:, k] = np.log(w) - 0.5 * (z**2).sum(0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diagonal": k * d, "spherical": k}[self.kind]


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def fit(points: DataFrame, means: list[list[float]], kind: str = "full", max_iter: int = 100, tol: float = 1e-3, reg: float = 1e-6) -> Mixture:
    """EM from given means with unit covariances; stops when the mean log-likelihood changes by less than ``tol``.

    A task returns k rows of sums (weight, total, outer products or, where the kind needs no more, squares), so what
    is moved does not grow with the points.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    m = np.array(means, float)
    k, d = m.shape
    alone = kind in ("diagonal", "spherical")
    width = d if alone else d * d
    model, last = Mixture(np.full(k, 1 / k), m, np.stack([np.eye(d)] * k), kind), None
    for step in range(1, max_iter + 1):

        def sums(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            n, t, o, ll = np.zeros(k), np.zeros((k, d)), np.zeros((k, width)), 0.0
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["v"].to_numpy())
                    p = model.log_densities(x)
                    total = _log_sum(p)
                    g = np.exp(p - total[:, None])
                    n, t, ll = n + g.sum(0), t + g.T @ x, ll + total.sum()
                    o = o + (g.T @ (x * x) if alone else np.einsum("nk,ni,nj->kij", g, x, x).reshape(k, -1))
            yield pd.DataFrame({"k": np.arange(k), "n": n, "t": list(t), "o": list(o), "ll": ll / k})

        rows = points.select("v").mapInPandas(sums, "k int, n double, t array<double>, o array<double>, ll double")
        added = lambda c, size: F.array(*(F.sum(F.col(c)[i]) for i in range(size))).alias(c)
        got = sorted(rows.groupBy("k").agg(F.sum("n").alias("n"), added("t", d), added("o", width), F.sum("ll").alias("ll")).collect(), key=lambda r: r["k"])
        n = np.array([r["n"] for r in got])
        count, ll = n.sum(), sum(r["ll"] for r in got) / n.sum()
        safe = np.maximum(n, 1e-12)
        means_ = np.array([r["t"] for r in got]) / safe[:, None]
        squares = np.array([r["o"] for r in got]) / safe[:, None]
        if alone:
            cov = np.stack([np.diag(v) for v in squares - means_**2])
        else:
            cov = squares.reshape(k, d, d) - np.einsum("ki,kj->kij", means_, means_)
        if kind == "tied":
            cov = np.stack([np.einsum("k,kij->ij", n, cov) / count] * k)
        elif kind == "spherical":
            cov = np.stack([np.eye(d) * np.trace(c) / d for c in cov])
        model = Mixture(n / count, means_, cov + reg * np.eye(d), kind, float(ll), step)
        if last is not None and abs(ll - last) < tol:
            break
        last = ll
    return model


def predict(points: DataFrame, model: Mixture) -> DataFrame:
    """(id, label, proba, score): the likeliest component, all responsibilities and the log-likelihood of each point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                p = model.log_densities(np.stack(pdf["v"].to_numpy()))
                total = _log_sum(p)
                yield pd.DataFrame({"id": pdf["id"], "label": p.argmax(1), "proba": list(np.exp(p - total[:, None])), "score": total})

    return points.select("id", "v").mapInPandas(run, "id long, label long, proba array<double>, score double")


def information_criteria(points: DataFrame, model: Mixture) -> DataFrame:
    """(aic, bic)."""
    n = model.parameters()
    total = predict(points, model).agg(F.sum("score").alias("ll"), F.count("*").alias("n"))
    return total.select((2 * n - 2 * F.col("ll")).alias("aic"), (n * F.log("n") - 2 * F.col("ll")).alias("bic"))
