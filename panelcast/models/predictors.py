"""Fitted regressors as small numpy objects that travel to the tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Pairs of row and tree that walk down together; bounds what a task holds of large ensembles.
CELLS = 500_000


@dataclass(frozen=True)
class LinearPredictor:
    coefficients: np.ndarray
    intercept: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients + self.intercept


@dataclass(frozen=True)
class FourierPredictor:
    """Linear in random Fourier features of the scaled inputs."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    linear: LinearPredictor

    def features(self, x: np.ndarray) -> np.ndarray:
        angle = ((x - self.mean) / self.scale) @ self.weights + self.offsets
        return np.sqrt(2.0 / len(self.offsets)) * np.cos(angle)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.linear(self.features(x))


@dataclass(frozen=True)
class TreePredictor:
    """All trees of an ensemble in flat node arrays; every row walks all trees together."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    depth: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        size = max(1, CELLS // len(self.roots))
        return np.concatenate([self._walk(x[i:i + size]) for i in range(0, max(1, len(x)), size)])

    def _walk(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            inner = self.feature[node] >= 0
            goes_left = x[rows, np.maximum(self.feature[node], 0)] <= self.threshold[node]
            child = np.where(goes_left, self.left[node], self.right[node])
            node = np.where(inner, child, node)
        return self.value[node] @ self.weights
