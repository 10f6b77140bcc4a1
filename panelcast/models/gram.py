"""Sufficient statistics of linear models: one pass over the rows, then small dense algebra.

The Gram matrix of ``[1, features, label]`` is formed block by block inside the tasks and summed by
Spark, so its size depends on the number of features only. Every ridge-like fit, any penalty, any
fold, follows from it without touching the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gram:
    """Moments of standardised features and centred label."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    y_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @classmethod
    def from_sums(cls, sums: np.ndarray) -> Gram:
        n = sums[0, 0]
        mean, y_mean = sums[0, 1:-1] / n, sums[0, -1] / n
        cross = sums[1:-1, 1:-1] - n * np.outer(mean, mean)
        variance = np.diag(cross) / n
        # Rounding noise of a constant feature is no variance.
        live = variance > 1e-12 * np.maximum(1.0, mean**2)
        scale = np.where(live, np.sqrt(np.where(live, variance, 1.0)), 1.0)
        xx = np.where(np.outer(live, live), cross / np.outer(scale, scale), 0.0)
        xy = np.where(live, (sums[1:-1, -1] - n * mean * y_mean) / scale, 0.0)
        return cls(n, mean, scale, y_mean, xx, xy, sums[-1, -1] - n * y_mean**2)

    def plain(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept for unscaled features."""
        raw = w / self.scale
        return raw, float(self.y_mean - raw @ self.mean)


def gram(frame: DataFrame, names: list[str]) -> Gram:
    return grams(frame.withColumn("_g", F.lit(0)), names, "_g")[0]


def grams(frame: DataFrame, names: list[str], group: str) -> dict[int, Gram]:
    """One Gram per value of an integer group column (a few folds)."""
    size = len(names) + 2

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, rows in batch.groupby(group):
                z = np.column_stack([np.ones(len(rows)), rows[[*names, "y"]].to_numpy(float)])
                sums[g] = sums.get(g, 0.0) + z.T @ z
        for g, total in sums.items():
            yield pd.DataFrame({"g": g, "i": np.arange(size), "row": list(total)})

    parts = frame.select(group, *names, "y").mapInPandas(partial, "g int, i int, row array<double>")
    summed = parts.select("g", "i", F.posexplode("row").alias("j", "v")).groupBy("g", "i", "j").agg(
        F.sum("v").alias("v")
    )
    cells = summed.toPandas()
    out = {}
    for g, rows in cells.groupby("g"):
        total = np.zeros((size, size))
        total[rows["i"], rows["j"]] = rows["v"]
        out[int(g)] = Gram.from_sums(total)
    return out


def ridge(g: Gram, alpha: float) -> np.ndarray:
    """Standardised coefficients; ``alpha=0`` gives the shortest least-squares solution."""
    if alpha == 0:
        return np.linalg.lstsq(g.xx, g.xy, rcond=1e-12)[0]
    return np.linalg.solve(g.xx + alpha * np.eye(len(g.xy)), g.xy)


def elastic_net(
    g: Gram, alpha: float, ratio: float, sweeps: int = 2000, tol: float = 1e-5
) -> np.ndarray:
    """Coordinate descent on the Gram matrix."""
    w = np.zeros(len(g.xy))
    l1, l2 = alpha * ratio * g.n, alpha * (1 - ratio) * g.n
    diagonal = np.diag(g.xx)
    for _ in range(sweeps):
        largest = 0.0
        for j in np.flatnonzero(diagonal > 0):
            rho = g.xy[j] - g.xx[j] @ w + diagonal[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (diagonal[j] + l2)
            largest, w[j] = max(largest, abs(new - w[j])), new
        if largest <= tol * max(np.abs(w).max(), 1e-12):
            break
    return w


def bayesian_ridge(
    g: Gram, rounds: int = 300, tol: float = 1e-3, prior: float = 1e-6
) -> tuple[np.ndarray, float]:
    """Ridge with noise and weight precision at their evidence maximum (flat gamma priors)."""
    values, vectors = np.linalg.eigh(g.xx)
    values = np.maximum(values, 0.0)
    target = vectors.T @ g.xy
    noise, weight = 1.0 / max(g.yy / g.n, 1e-12), 1.0
    w = np.zeros(len(g.xy))
    for _ in range(rounds):
        old, w = w, vectors @ (target / (values + weight / noise))
        error = max(g.yy - 2 * w @ g.xy + w @ g.xx @ w, 0.0)
        used = np.sum(noise * values / (weight + noise * values))
        weight = (used + 2 * prior) / (w @ w + 2 * prior)
        noise = (g.n - used + 2 * prior) / (error + 2 * prior)
        if np.sum(np.abs(w - old)) < tol:
            break
    return g.plain(w)
