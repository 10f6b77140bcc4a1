"""Alignments of forecasts: wide prediction tables and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oof_matrix(forecast: DataFrame, models: list[str]) -> DataFrame:
    """One column of predictions per model. The model ids are given, so no job collects them."""
    return forecast.groupBy("series_key", "ds").pivot("model", models).agg(F.first("yhat"))
