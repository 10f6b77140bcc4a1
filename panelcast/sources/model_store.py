"""Keeping fitted models as Parquet tables, by dataset and model, with a row per series.

A forecaster names the tables of its fit (coefficients, smoothed states, neighbours' rows, networks, the
numbers of a pooled regressor, the members of an ensemble); they are written by Spark and read back where a
forecast needs them, so neither the series nor their states pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from panelcast.models.base import Forecaster
from panelcast.models.pooled import Fitted, fitted_from, fitted_table
from panelcast.sources.files import safe_name


def model_path(folder: str, dataset: str, name: str) -> str:
    return f"{folder}/{dataset}_{safe_name(name)}"


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Write the numbers of a fitted pooled regressor."""
    fitted_table(spark, fitted).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Fitted:
    return fitted_from(spark.read.parquet(path))


@dataclass(frozen=True)
class StoredForecaster:
    """A fitted model in a store. It forecasts without the rows it was fitted on."""

    model: Forecaster
    path: str

    def forecast(self, future: DataFrame) -> DataFrame:
        spark = future.sparkSession
        return self.model.from_state(lambda name: spark.read.parquet(f"{self.path}/{name}"), future)


def save_forecaster(model: Forecaster, train: DataFrame, folder: str, dataset: str) -> StoredForecaster:
    """Fit ``model`` on all series of ``train`` and write what its forecasts need."""
    path = model_path(folder, dataset, model.name)
    for name, table in model.state(train).items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return StoredForecaster(model, path)


def load_forecaster(model: Forecaster, folder: str, dataset: str) -> StoredForecaster:
    """The stored fit of ``model`` (an entry of the registry) on a dataset."""
    return StoredForecaster(model, model_path(folder, dataset, model.name))
