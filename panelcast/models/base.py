"""What a forecaster is, and running several of them over a panel.

A forecaster takes training rows ``(series_key, ds, y)`` and the periods to predict
``(series_key, step, ds)`` and returns ``(series_key, step, ds, yhat)``. A series it cannot fit gets
null predictions, so one bad series never stops the panel.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


log = logging.getLogger(__name__)
AT_ONCE = 4
"""Fits whose jobs the driver starts at the same time."""


class Forecaster(Protocol):
    id: str
    name: str

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame: ...


def series_arrays(train: DataFrame) -> DataFrame:
    """One row per series with its values in time order: ``(series_key, n, ys)``.

    A series has one value per calendar period, so the arrays are bounded however large the facts.
    """
    rows = F.sort_array(F.collect_list(F.struct("ds", "y")))
    return train.groupBy("series_key").agg(rows.alias("_rows")).select(
        "series_key", F.size("_rows").alias("n"), F.col("_rows.y").alias("ys")
    )


def tail_array(train: DataFrame, k: int) -> DataFrame:
    """The last k values of each series, oldest first; earlier rows never reach the exchange's
    reduce side because the row limit is applied before grouping."""
    newest = Window.partitionBy("series_key").orderBy(F.desc("ds"))
    tail = train.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= k)
    return series_arrays(tail.drop("_back"))


def cogroup_series(
    left: DataFrame, right: DataFrame, function: Callable, schema: str
) -> DataFrame:
    """``function(left_rows, right_rows)`` per series.

    Both sides often descend from one panel. The right one gets names of its own on the way, because
    columns the two sides share by descent would be dropped from it.
    """
    renamed = right.toDF(*[f"r_{c}" for c in right.columns])

    def call(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return function(a, b.rename(columns=lambda c: c.removeprefix("r_")))

    return left.groupBy("series_key").cogroup(renamed.groupBy("r_series_key")).applyInPandas(
        call, schema
    )


Read = Callable[[str], DataFrame]
"""Gives a table of a fitted model by its name."""


class Keeping:
    """A forecaster whose fit is a set of named tables: ``state`` makes them from training rows and
    ``from_state`` forecasts from them alone, so they can be stored and read back."""

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        raise NotImplementedError

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        return self.from_state(self.state(train).__getitem__, future)


@dataclass(frozen=True)
class CustomForecaster:
    """A user's function ``(history, steps) -> forecast`` over pandas frames of one series."""

    id: str
    name: str
    function: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        function = self.function

        def one(history: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
            steps = steps.sort_values("step")[["series_key", "step", "ds"]]
            try:
                yhat = function(history.sort_values("ds"), steps)
                return steps.assign(yhat=[float(v) for v in yhat])
            except Exception:  # noqa: BLE001 - a failing series becomes null rows
                return steps.assign(yhat=float("nan"))

        out = cogroup_series(train, future, one,
                             "series_key string, step int, ds date, yhat double")
        return out.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))


CUSTOM: dict[str, Forecaster] = {}


def register_forecaster(model: Forecaster) -> Forecaster:
    """Let a forecaster take part in every benchmark under its id."""
    CUSTOM[model.id] = model
    return model


def run_models(
    models: Iterable[Forecaster], train: DataFrame, future: DataFrame
) -> DataFrame:
    """Forecasts of all models in one frame with a ``model`` column.

    A model whose fit raises gets null predictions, which ``fit_status`` reports as failed; the others
    go on. Models that learn from the same feature rows (equal ``shape``) share one stored copy of them, tree
    ensembles among them are fitted in one job, and the jobs of independent fits run at the same time.
    """
    models = list(models)
    shapes = [getattr(m, "shape", None) for m in models]
    shared = {s: next(m for m, other in zip(models, shapes, strict=True) if other == s)
              for s in shapes if s is not None and shapes.count(s) > 1}
    frames = {s: m.features(train).persist(StorageLevel.MEMORY_AND_DISK) for s, m in shared.items()}
    groups: dict[tuple, list] = {}
    for m, s in zip(models, shapes, strict=True):
        if s in frames and getattr(m, "ensemble", None) is not None:
            groups.setdefault(s, []).append(m)

    def together(members: list, shape: tuple) -> dict[str, object]:
        start = time.monotonic()
        out = dict(zip([m.id for m in members], members[0].fit_all(members, frames[shape]), strict=True))
        log.info("models %s fitted in %.1f s", ", ".join(out), time.monotonic() - start)
        return out

    def one(m: Forecaster, shape: tuple | None) -> DataFrame:
        try:
            start = time.monotonic()
            if shape not in frames:
                out = m.forecast(train, future)
            elif m in groups.get(shape, ()):
                out = fits[shape].result()[m.id].forecast(train, future)
            else:
                out = m.fit_on(frames[shape]).forecast(train, future)
            log.info("model %s ready after %.1f s", m.id, time.monotonic() - start)
        except Exception as error:  # noqa: BLE001 - one model must not stop the others
            log.warning("model %s failed: %s", m.id, error)
            out = future.withColumn("yhat", F.lit(None).cast("double"))
        return out.select("series_key", F.lit(m.id).alias("model"), "step", "ds", "yhat")

    try:
        with ThreadPoolExecutor(AT_ONCE + len(groups)) as pool:
            fits = {s: pool.submit(together, members, s) for s, members in groups.items()}
            parts = list(pool.map(one, models, shapes))
        return reduce(DataFrame.unionByName, parts)
    finally:
        for frame in frames.values():
            frame.unpersist()


def fit_status(forecast: DataFrame) -> DataFrame:
    """``ok`` or ``failed`` per series and model."""
    broken = F.bool_or(F.col("yhat").isNull())
    return forecast.groupBy("series_key", "model").agg(
        F.when(broken, "failed").otherwise("ok").alias("status")
    )
