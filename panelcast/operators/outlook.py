"""What comes after the model: future dates, bands, overlays, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.freq import shift_period
from panelcast.functions.numeric import fixed

BAND = 0.10


def future_index(series: DataFrame, periods: int, freq: str) -> DataFrame:
    """The next ``periods`` labels of each series: ``(series_key, step, ds)``."""
    last = series.groupBy("series_key").agg(F.max("ds").alias("last"))
    steps = last.select("series_key", "last", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias(
        "step"))
    return steps.select("series_key", "step",
                        shift_period(F.col("last"), F.col("step"), freq).alias("ds"))


def forecast_band(forecast: DataFrame, width: float = BAND) -> DataFrame:
    """Fixed-width band of plus and minus ten percent (no confidence interval)."""
    return forecast.withColumn("lo", F.col("yhat") * F.lit(1.0 - width)).withColumn(
        "hi", F.col("yhat") * F.lit(1.0 + width)
    )


def forecast_overlay(
    train: DataFrame, test: DataFrame, predicted: DataFrame, future: DataFrame
) -> DataFrame:
    """History, hold-out, its prediction and the future in one long table."""
    def part(df: DataFrame, value: str, label: str) -> DataFrame:
        return df.select("series_key", "ds", F.lit(label).alias("segment"),
                         F.col(value).alias("value"))

    return (
        part(train, "y", "train").unionByName(part(test, "y", "test"))
        .unionByName(part(predicted, "yhat", "predicted"))
        .unionByName(part(future, "yhat", "future"))
    )


def history_forecast_outer(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast side by side on the date."""
    return series.join(
        forecast.select("series_key", "ds", "yhat"), ["series_key", "ds"], "full_outer"
    ).select("series_key", "ds", "y", "yhat")


CRORE = 1e7
LAKH = 1e5


def format_inr(value: Column, digits: int = 0) -> Column:
    """Rupees: crore from ten million, lakh from a hundred thousand, else a plain amount."""
    return (
        F.when(value >= CRORE, F.concat(F.lit("₹"), fixed(value / CRORE, 2),
                                        F.lit(" Cr")))
        .when(value >= LAKH, F.concat(F.lit("₹"), fixed(value / LAKH, 2),
                                      F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), F.format_number(value, digits)))
    )
