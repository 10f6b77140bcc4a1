"""Combining forecasters: weights by inverse error, and stacking."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import not_negative
from panelcast.models.base import Forecaster, Read, cogroup_series, run_models
from panelcast.operators.joins import oof_matrix
from panelcast.operators.series import with_position
from panelcast.plans.folds import out_of_fold
from panelcast.session import cut_lineage

VALIDATION = 0.15
MIN_VALIDATION = 7


def validation_split(series: DataFrame, ratio: float = VALIDATION) -> tuple[DataFrame, DataFrame]:
    """All but the last max(7, ⌊ratio·n⌋) rows of each series, and those rows with their step."""
    held = F.greatest(F.lit(MIN_VALIDATION), F.floor(F.col("n") * F.lit(ratio)).cast("int"))
    placed = with_position(series).withColumn("_cut", F.col("n") - held)
    train = placed.where(F.col("pos") < F.col("_cut")).select("series_key", "ds", "y")
    test = placed.where(F.col("pos") >= F.col("_cut")).select(
        "series_key", (F.col("pos") - F.col("_cut") + 1).cast("int").alias("step"), "ds", "y"
    )
    return train, test


def ensemble_weights(models: Iterable[Forecaster], series: DataFrame) -> DataFrame:
    """Weight of each model per series, 1 / (RMSE + 1e-9) on the validation rows, summing to 1.

    A model that failed on a series has weight 0 there.
    """
    train, test = validation_split(cut_lineage(series))
    scored = run_models(models, train, test.drop("y")).select(
        "series_key", "model", "step", "yhat"
    ).join(test, ["series_key", "step"])
    error = F.col("y") - F.col("yhat")
    raw = scored.groupBy("series_key", "model").agg(
        F.when(F.bool_and(F.col("yhat").isNotNull()),
               F.lit(1.0) / (F.sqrt(F.avg(error * error)) + F.lit(1e-9)))
        .otherwise(F.lit(0.0)).alias("_w")
    )
    total = F.sum("_w").over(Window.partitionBy("series_key"))
    weight = F.when(total > 0, F.col("_w") / total).otherwise(F.lit(0.0))
    return raw.select("series_key", "model", weight.alias("weight"))


def ensemble_predict(forecast: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the forecasts there are, at or above 0; null where no weighted model has one."""
    there = F.when(F.col("yhat").isNotNull(), F.col("weight"))
    mean = F.try_divide(F.sum(F.col("yhat") * F.col("weight")), F.sum(there))
    return forecast.join(weights, ["series_key", "model"]).groupBy("series_key", "step", "ds").agg(
        not_negative(mean).alias("yhat")
    )


class WeightedEnsemble:
    """The weighted combination as a forecaster of its own. A model that fails on the validation rows of
    a series has no weight there."""

    id = "weighted_ensemble"
    name = "Weighted Ensemble"
    pooled = True

    def __init__(self, models: Iterable[Forecaster], limit: int | None = None) -> None:
        self.models = list(models)[:limit]

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        train = cut_lineage(train)
        weights = ensemble_weights(self.models, train)
        return ensemble_predict(run_models(self.models, train, future), weights)

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        train = cut_lineage(train)
        return {"weights": ensemble_weights(self.models, train), **member_states(self.models, train)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        return ensemble_predict(member_forecasts(self.models, read, future), read("weights"))


def member_states(models: Iterable[Forecaster], train: DataFrame) -> dict[str, DataFrame]:
    return {f"{m.id}/{name}": table for m in models for name, table in m.state(train).items()}


def member_forecasts(models: Iterable[Forecaster], read: Read, future: DataFrame) -> DataFrame:
    """Forecasts of stored members in one frame."""
    def one(m: Forecaster) -> DataFrame:
        out = m.from_state(lambda name: read(f"{m.id}/{name}"), future)
        return out.select("series_key", F.lit(m.id).alias("model"), "step", "ds", "yhat")

    return reduce(DataFrame.unionByName, map(one, models))


STACK_SCHEMA = "series_key string, intercept double, weights array<double>"


def stacking_weights(oof: DataFrame, ids: list[str], alpha: float = 1.0) -> DataFrame:
    """Ridge with intercept from out-of-fold forecasts to actuals, one fit per series.

    Spark forms the moments of each series; a task only solves systems of as many unknowns as there
    are models.
    """
    actual = oof.groupBy("series_key", "ds").agg(F.first("y").alias("y"))
    wide = oof_matrix(oof, ids).join(actual, ["series_key", "ds"])
    pairs = [F.covar_pop(a, b) for a in ids for b in ids]
    moments = wide.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("my"),
        F.array(*[F.avg(c) for c in ids]).alias("mx"),
        F.array(*pairs).alias("xx"), F.array(*[F.covar_pop(c, "y") for c in ids]).alias("xy"),
    )
    size = len(ids)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["n"].to_numpy(dtype=float)
            xx = np.stack(batch["xx"]).reshape(-1, size, size) * n[:, None, None]
            xy = np.stack(batch["xy"]) * n[:, None]
            w = np.linalg.solve(xx + alpha * np.eye(size), xy[:, :, None])[:, :, 0]
            intercept = batch["my"].to_numpy() - (w * np.stack(batch["mx"])).sum(axis=1)
            yield pd.DataFrame({"series_key": batch["series_key"], "intercept": intercept,
                                "weights": list(w)})

    return moments.mapInPandas(solve, STACK_SCHEMA)


def meta_forecast(oof: DataFrame, wide: DataFrame, ids: list[str], make: Callable[[], object]) -> DataFrame:
    """Forecasts of a user's meta-model, fitted per series on the out-of-fold forecasts."""
    actual = oof.groupBy("series_key", "ds").agg(F.first("y").alias("y"))
    known = oof_matrix(oof, ids).join(actual, ["series_key", "ds"])

    def one(rows: pd.DataFrame, coming: pd.DataFrame) -> pd.DataFrame:
        out = coming[["series_key", "step", "ds"]]
        try:
            rows = rows.sort_values("ds")
            meta = make()
            meta.fit(rows[ids].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))
            return out.assign(yhat=np.maximum(np.asarray(meta.predict(coming[ids].to_numpy(dtype=float)), dtype=float), 0.0))
        except Exception:  # noqa: BLE001 - a failing series becomes null rows
            return out.assign(yhat=np.nan)

    out = cogroup_series(known, wide, one, "series_key string, step int, ds date, yhat double")
    return out.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat")))


class Stacking:
    """Out-of-fold forecasts combined by ridge, bases refitted on all rows. A base that fails counts as the
    mean of the series.

    ``meta`` makes an object with ``fit(X, y)`` and ``predict(X)`` that takes the place of the ridge; it is
    fitted once per series, on as many rows as the series has out-of-fold periods.
    """

    id = "stacking"
    name = "Stacking Regressor"
    pooled = True

    def __init__(
        self, models: Iterable[Forecaster], folds: int = 5, alpha: float = 1.0,
        limit: int | None = None, meta: Callable[[], object] | None = None,
    ) -> None:
        self.models = list(models)[:limit]
        self.meta = meta
        if len(self.models) < 3:
            raise ValueError("stacking needs at least three models")
        self.folds, self.alpha = folds, alpha

    def forecast(self, train: DataFrame, future: DataFrame) -> DataFrame:
        train = cut_lineage(train)
        ids = [m.id for m in self.models]
        oof = out_of_fold(self.models, train, self.folds)
        means = train.groupBy("series_key").agg(F.avg("y").alias("_mean"))
        base = run_models(self.models, train, future)
        if self.meta is not None:
            return meta_forecast(oof, self._wide(base, means), ids, self.meta)
        return self._combined(base, means, stacking_weights(oof, ids, self.alpha))

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        train, ids = cut_lineage(train), [m.id for m in self.models]
        oof = out_of_fold(self.models, train, self.folds)
        known = {"oof": oof} if self.meta is not None else {"weights": stacking_weights(oof, ids, self.alpha)}
        means = train.groupBy("series_key").agg(F.avg("y").alias("_mean"))
        return {**known, "means": means, **member_states(self.models, train)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        base = member_forecasts(self.models, read, future)
        if self.meta is not None:
            return meta_forecast(read("oof"), self._wide(base, read("means")), [m.id for m in self.models], self.meta)
        return self._combined(base, read("means"), read("weights"))

    def _wide(self, base: DataFrame, means: DataFrame) -> DataFrame:
        filled = base.join(means, "series_key").withColumn("yhat", F.coalesce("yhat", "_mean"))
        return filled.groupBy("series_key", "step", "ds").pivot("model", [m.id for m in self.models]).agg(F.first("yhat"))

    def _combined(self, base: DataFrame, means: DataFrame, weights: DataFrame) -> DataFrame:
        wide, ids = self._wide(base, means), [m.id for m in self.models]
        value = F.col("intercept")
        for i, c in enumerate(ids):
            value = value + F.col("weights")[i] * F.col(c)
        return wide.join(weights, "series_key").select(
            "series_key", "step", "ds", not_negative(value).alias("yhat")
        )
