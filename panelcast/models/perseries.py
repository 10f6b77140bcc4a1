"""Regressors fitted separately on each series: neighbours, a small network, user estimators.

The feature rows of a series and its coming dates meet in one co-grouped task; a series has one row
per calendar period, which bounds the task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.calendar import CALENDAR_NAMES, calendar_features
from panelcast.models.base import Read, cogroup_series, register_forecaster
from panelcast.models.recursion import roll_forward
from panelcast.operators.features import (
    EVERY,
    ROLL_WINDOWS,
    feature_matrix,
    feature_names,
)
from panelcast.operators.series import log1p_transform

SEED = 42


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = x.std(axis=0)
    return x.mean(axis=0), np.where(scale > 0, scale, 1.0)


def nearest(train: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and positions of the k nearest training rows, blocks of rows at a time; a block's
    differences take 16 MB at most."""
    k = min(k, len(train))
    distances, places = [], []
    size = max(1, 2_000_000 // max(1, train.size))
    for start in range(0, len(rows), size):
        block = rows[start:start + size]
        d = np.sqrt(((block[:, None, :] - train[None, :, :]) ** 2).sum(axis=2))
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        places.append(order)
        distances.append(np.take_along_axis(d, order, axis=1))
    return np.vstack(distances), np.vstack(places)


def weighted_mean(distance: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean of neighbour values by inverse distance; exact matches take all the weight."""
    exact = distance == 0
    with np.errstate(divide="ignore"):
        weight = np.where(exact.any(axis=1, keepdims=True), exact.astype(float), 1.0 / distance)
    return (weight * y).sum(axis=1) / weight.sum(axis=1)


def fit_knn(x: np.ndarray, y: np.ndarray, k: int = 5) -> Callable[[np.ndarray], np.ndarray]:
    mean, scale = standardise(x)
    train = (x - mean) / scale

    def predict(rows: np.ndarray) -> np.ndarray:
        distance, place = nearest(train, (rows - mean) / scale, k)
        return weighted_mean(distance, y[place])

    return predict


def fit_mlp(
    x: np.ndarray, y: np.ndarray, hidden: tuple[int, int] = (32, 16), rate: float = 1e-3,
    penalty: float = 0.1, epochs: int = 1000, patience: int = 20, held_out: float = 0.15,
    tol: float = 1e-4,
) -> Callable[[np.ndarray], np.ndarray]:
    """Two hidden layers, robust scaling, Adam, stopped when the held-out fit stalls."""
    low, mid, high = np.percentile(x, [25, 50, 75], axis=0)
    spread = np.where(high > low, high - low, 1.0)
    rng = np.random.default_rng(SEED)
    z = (x - mid) / spread
    order = rng.permutation(len(z))
    cut = max(1, int(np.ceil(held_out * len(z))))
    val, fit = order[:cut], order[cut:]
    sizes = (z.shape[1], *hidden, 1)
    weights = [rng.uniform(-1, 1, (a, b)) * np.sqrt(6.0 / (a + b))
               for a, b in zip(sizes, sizes[1:], strict=False)]
    biases = [np.zeros(b) for b in sizes[1:]]
    params = weights + biases
    layers = len(weights)
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]

    def forward(rows: np.ndarray) -> list[np.ndarray]:
        out = [rows]
        for i in range(layers):
            s = out[-1] @ params[i] + params[layers + i]
            out.append(np.maximum(s, 0.0) if i < layers - 1 else s)
        return out

    best, best_loss, stale, t = [p.copy() for p in params], np.inf, 0, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for start in range(0, len(fit), 200):
            rows = fit[start:start + 200]
            out = forward(z[rows])
            delta = (out[-1][:, 0] - y[rows])[:, None] / len(rows)
            grads = [None] * len(params)
            for i in range(layers - 1, -1, -1):
                grads[i] = out[i].T @ delta + penalty * params[i] / len(rows)
                grads[layers + i] = delta.sum(axis=0)
                delta = (delta @ params[i].T) * (out[i] > 0)
            t += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                params[i] -= step * first[i] / (np.sqrt(second[i]) + 1e-8)
        loss = float(np.mean((forward(z[val])[-1][:, 0] - y[val]) ** 2))
        stale = stale + 1 if loss > best_loss - tol else 0
        if loss < best_loss:
            best, best_loss = [p.copy() for p in params], loss
        if stale >= patience:
            break
    params = best
    return lambda rows: forward((rows - mid) / spread)[-1][:, 0]


def fit_estimator(make: Callable[[], object]) -> Callable:
    """Adapter for objects with ``fit(X, y)`` and ``predict(X)``; inputs are standardised."""
    def fit(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        mean, scale = standardise(x)
        estimator = make()
        estimator.fit((x - mean) / scale, y)
        return lambda rows: np.asarray(estimator.predict((rows - mean) / scale), dtype=float)

    return fit


@dataclass(frozen=True)
class PerSeriesRegressor:
    """``fit(X, y) -> predict`` run on the feature rows of each series."""

    id: str
    name: str
    fit: Callable
    lags: int = 14
    log: bool = True
    signed: bool = False
    options: dict = field(default_factory=dict, hash=False)
    warmup: str = "zero"

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        longest = EVERY
        lags, signed, fit = self.lags, self.signed, self.fit
        options, warmup = self.options, self.warmup
        names = feature_names(lags, longest)
        calendar = list(CALENDAR_NAMES)

        def one(rows: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
            rows, coming = rows.sort_values("ds"), coming.sort_values("step")
            out = coming[["series_key", "step", "ds"]]
            if rows.empty or coming.empty:
                return out.assign(yhat=np.nan)
            try:
                y = rows["y"].to_numpy(dtype=float)
                cold = 0 if warmup == "zero" else min(max(ROLL_WINDOWS), len(y) // 4)
                predict = fit(rows[names].to_numpy(dtype=float)[cold:], y[cold:], **options)
                path = roll_forward(
                    [y], coming[calendar].to_numpy(dtype=float)[None], rows["use_log"].to_numpy()[:1],
                    predict, lags, longest, signed,
                )
                return out.assign(yhat=path[0])
            except Exception:  # noqa: BLE001 - a failing series becomes null rows
                return out.assign(yhat=np.nan)

        frame = feature_matrix(log1p_transform(train, self.log), lags, longest)
        dated = future.withColumns(calendar_features(F.col("ds"))).select(
            "series_key", "step", "ds", *[F.col(c).cast("double").alias(c) for c in calendar]
        )
        out = cogroup_series(frame, dated, one,
                             "series_key string, step int, ds date, yhat double")
        return out.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))


    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        """The fitted object of each series with the series' values."""
        names, fit, options, warmup = feature_names(self.lags, EVERY), self.fit, self.options, self.warmup

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("ds")
            y = rows["y"].to_numpy(dtype=float)
            cold = 0 if warmup == "zero" else min(max(ROLL_WINDOWS), len(y) // 4)
            try:
                fitted = cloudpickle.dumps(fit(rows[names].to_numpy(dtype=float)[cold:], y[cold:], **options))
            except Exception:  # noqa: BLE001 - a series without a fit gets null rows
                fitted = None
            return pd.DataFrame({"series_key": rows["series_key"].iloc[:1], "ys": [y], "use_log": rows["use_log"].iloc[:1].to_numpy(),
                                 "fitted": [fitted]})

        frame = feature_matrix(log1p_transform(train, self.log), self.lags, EVERY)
        return {"fitted": frame.groupBy("series_key").applyInPandas(
            one, "series_key string, ys array<double>, use_log boolean, fitted binary")}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        lags, signed, calendar = self.lags, self.signed, list(CALENDAR_NAMES)

        def one(kept: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
            coming = coming.sort_values("step")
            out = coming[["series_key", "step", "ds"]]
            if kept.empty or coming.empty or kept["fitted"].iloc[0] is None:
                return out.assign(yhat=np.nan)
            try:
                path = roll_forward(
                    [np.asarray(kept["ys"].iloc[0], dtype=float)], coming[calendar].to_numpy(dtype=float)[None],
                    kept["use_log"].to_numpy()[:1], cloudpickle.loads(kept["fitted"].iloc[0]), lags, EVERY, signed)
                return out.assign(yhat=path[0])
            except Exception:  # noqa: BLE001 - a failing series becomes null rows
                return out.assign(yhat=np.nan)

        dated = future.withColumns(calendar_features(F.col("ds"))).select(
            "series_key", "step", "ds", *[F.col(c).cast("double").alias(c) for c in calendar])
        out = cogroup_series(read("fitted"), dated, one, "series_key string, step int, ds date, yhat double")
        return out.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))


def register_estimator(id: str, name: str, make: Callable[[], object], **settings) -> PerSeriesRegressor:
    """Let any object with ``fit(X, y)`` and ``predict(X)`` take part in every benchmark, its forecasts fed
    back step by step. ``make`` builds a fresh one for each series."""
    return register_forecaster(PerSeriesRegressor(id, name, fit_estimator(make), **settings))


def neighbor_join(
    train: DataFrame, rows: DataFrame, features: list[str], k: int = 5
) -> DataFrame:
    """The k nearest training rows of each query row of the same series, by standardised distance:
    ``(series_key, ds, rank, neighbor_ds, distance, y)``. Only the k best pairs leave a task."""
    def one(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = ["series_key", "ds", "rank", "neighbor_ds", "distance", "y"]
        if known.empty or asked.empty:
            return pd.DataFrame(columns=columns)
        known = known.sort_values("ds")
        x = known[features].to_numpy(dtype=float)
        mean, scale = standardise(x)
        distance, place = nearest(
            (x - mean) / scale, (asked[features].to_numpy(dtype=float) - mean) / scale, k
        )
        width = place.shape[1]
        flat = place.ravel()
        return pd.DataFrame({
            "series_key": asked["series_key"].iloc[0],
            "ds": np.repeat(asked["ds"].to_numpy(), width),
            "rank": np.tile(np.arange(1, width + 1), len(asked)),
            "neighbor_ds": known["ds"].to_numpy()[flat],
            "distance": distance.ravel(),
            "y": known["y"].to_numpy(dtype=float)[flat],
        })

    keep = ["series_key", "ds", *features]
    return cogroup_series(
        train.select(*keep, "y"), rows.select(*keep), one,
        "series_key string, ds date, rank int, neighbor_ds date, distance double, y double",
    )


def knn_one_step(neighbors: DataFrame) -> DataFrame:
    """One-step predictions from a neighbour table."""
    exact = F.max((F.col("distance") == 0).cast("int"))
    weight = F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(
        F.try_divide(F.lit(1.0), F.col("distance"))
    )
    w = Window.partitionBy("series_key", "ds")
    return (
        neighbors.withColumn("_exact", exact.over(w)).withColumn("_w", weight)
        .groupBy("series_key", "ds").agg((F.sum(F.col("_w") * F.col("y")) / F.sum("_w")).alias("yhat"))
    )
