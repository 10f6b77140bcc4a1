"""Autoregression by least squares on the raw values, predictions fed back at or above 0."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.models.base import Keeping, Read, series_arrays
from panelcast.operators.series import by_time, last_values


@dataclass(frozen=True)
class AR1(Keeping):
    """One lag, fitted with the built-in regression aggregates."""

    id: str = "ar1"
    name: str = "AR(1)"

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        pairs = train.withColumn("lag", F.lag("y").over(by_time()))
        y, x = F.col("y"), F.col("lag")
        slope = F.regr_slope(y, x)
        # A constant series has no slope; it stays where it is.
        fit = pairs.groupBy("series_key").agg(
            F.coalesce(slope, F.lit(0.0)).alias("b"),
            F.when(slope.isNotNull(), F.regr_intercept(y, x))
            .otherwise(F.avg(F.when(x.isNotNull(), y))).alias("a"),
        )
        return {"fit": fit.join(last_values(train), "series_key")}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        value = F.aggregate(
            F.sequence(F.lit(1), F.col("step")), F.col("last_y"),
            lambda v, _: F.greatest(F.col("a") + F.col("b") * v, F.lit(0.0)),
        )
        return future.join(read("fit"), "series_key").select(
            "series_key", "step", "ds", F.when(F.col("a").isNotNull(), value).alias("yhat")
        )


def ar_coefficients(y: np.ndarray, p: int) -> np.ndarray:
    """Intercept and p coefficients, newest lag first (shortest solution when not unique)."""
    lagged = np.lib.stride_tricks.sliding_window_view(y[:-1], p)[:, ::-1]
    design = np.column_stack([np.ones(len(lagged)), lagged])
    return np.linalg.lstsq(design, y[p:], rcond=None)[0]


@dataclass(frozen=True)
class AR(Keeping):
    """p lags. The fit of each series runs in numpy over batches of series, the recursion in Spark."""

    p: int = 14
    id: str = "ar"
    name: str = "AR Model"

    def coefficients(self, train: DataFrame) -> DataFrame:
        p = self.p

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                beta = [
                    ar_coefficients(np.asarray(y, dtype=float), p) if len(y) > p else None
                    for y in batch["ys"]
                ]
                tail = [np.asarray(y[-p:], dtype=float)[::-1] for y in batch["ys"]]
                yield pd.DataFrame({"series_key": batch["series_key"], "beta": beta, "tail": tail})

        return series_arrays(train).select("series_key", "ys").mapInPandas(
            fit, "series_key string, beta array<double>, tail array<double>"
        )

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        return {"fit": self.coefficients(train)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        def advance(state: Column, _: Column) -> Column:
            dot = F.aggregate(
                F.zip_with(F.slice("beta", 2, self.p), state["h"], lambda b, v: b * v),
                F.lit(0.0), lambda s, v: s + v,
            )
            value = F.greatest(F.element_at("beta", 1) + dot, F.lit(0.0))
            return F.struct(
                F.concat(F.array(value), F.slice(state["h"], F.lit(1), F.size(state["h"]) - 1))
                .alias("h"),
                F.concat(state["out"], F.array(value)).alias("out"),
            )

        start = F.struct(F.col("tail").alias("h"), F.array().cast("array<double>").alias("out"))
        horizon = future.groupBy("series_key").agg(F.max("step").alias("h"))
        paths = read("fit").join(horizon, "series_key").select(
            "series_key",
            F.when(
                F.col("beta").isNotNull(),
                F.aggregate(F.sequence(F.lit(1), F.col("h")), start, advance)["out"],
            ).alias("path"),
        )
        return future.join(paths, "series_key", "left").select(
            "series_key", "step", "ds", F.get("path", F.col("step") - 1).alias("yhat")
        )
