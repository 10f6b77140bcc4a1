"""Scores of forecasts: error metrics, histograms, trends and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.numeric import clip, finite_or
from panelcast.operators.series import LIMIT

TINY = 1e-6
GATE = 0.8
BINS = 30


def actual_vs_predicted(test: DataFrame, forecast: DataFrame) -> DataFrame:
    """Hold-out rows with their predictions: ``(series_key, model, step, ds, y, yhat)``."""
    return forecast.select("series_key", "model", "step", "yhat").join(
        test, ["series_key", "step"]
    ).select("series_key", "model", "step", "ds", "y", "yhat")


def forecast_metrics(
    scored: DataFrame, keys: tuple[str, ...] = ("series_key", "model"), bound: float = LIMIT
) -> DataFrame:
    """MAE, MSE, RMSE, R², MAPE, sMAPE and MDAPE per series and model, unrounded.

    Forecasts count as at most ``bound``; by default only what a number cannot hold is cut.
    """
    y = F.col("y")
    p = clip(finite_or(F.col("yhat"), 0.0, bound, 0.0), 0.0, bound)
    err = y - p
    size, both = F.abs(y), F.abs(y) + F.abs(p)
    ape = F.when(size > TINY, F.abs(err) / size * 100)
    sape = F.when(both > TINY, F.lit(200.0) * F.abs(err) / both)
    close = F.abs(err) <= F.lit(1e-3) + F.lit(1e-5) * F.abs(p)
    sums = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("_var"),
        F.bool_and(close).alias("_close"),
        F.avg(ape).alias("mape"),
        F.coalesce(F.avg(sape), F.lit(0.0)).alias("smape"),
        F.coalesce(F.percentile(ape, F.lit(0.5)), F.lit(0.0)).alias("mdape"),
    )
    constant = F.sqrt("_var") < 1e-9
    r2 = F.when(constant, F.when(F.col("_close"), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))
    )
    return sums.select(
        *keys, "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"), "mape", "smape", "mdape"
    )


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics as the report prints them: two digits, R² four."""
    digits = {"mae": 2, "mse": 2, "rmse": 2, "r2": 4, "mape": 2, "smape": 2, "mdape": 2}
    return metrics.withColumns({c: F.bround(c, d) for c, d in digits.items()})


def residual_histogram(scored: DataFrame, bins: int = BINS) -> DataFrame:
    """Counts of the residuals in equal bins between their extremes, empty bins included."""
    keys = ["series_key", "model"]
    res = scored.select(*keys, (F.col("y") - F.col("yhat")).alias("res"))
    # A single residual value gets a bin range of one around it.
    limits = res.groupBy(*keys).agg(F.min("res").alias("lo"), F.max("res").alias("hi")).select(
        *keys,
        F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
        F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"),
    )
    place = F.least(F.width_bucket("res", "lo", "hi", F.lit(bins)), F.lit(bins))
    counts = [F.count_if(F.col("bin") == b) for b in range(1, bins + 1)]
    dense = (
        res.join(limits, keys).withColumn("bin", place)
        .groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                            F.array(*counts).alias("c"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return dense.select(*keys, "lo", "hi", F.posexplode("c").alias("bin", "count")).select(
        *keys, "bin", (F.col("lo") + width * F.col("bin")).alias("left"), "count"
    )


def market_trend(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """Mean forecast against mean history in percent, with the direction."""
    past = series.groupBy("series_key").agg(F.avg("y").alias("avg_hist"))
    future = forecast.groupBy("series_key").agg(F.avg("yhat").alias("avg_fut"))
    change = F.coalesce(
        F.try_divide(F.col("avg_fut") - F.col("avg_hist"), F.col("avg_hist")) * 100, F.lit(0.0)
    )
    return past.join(future, "series_key").withColumn("pct", change).withColumn(
        "direction", F.when(F.col("pct") >= 0, "higher").otherwise("lower")
    )


def forecast_summary(forecast: DataFrame, keys: tuple[str, ...] = ("series_key",)) -> DataFrame:
    return forecast.groupBy(*keys).agg(
        F.min("ds").alias("date_from"), F.max("ds").alias("date_to"),
        F.sum("yhat").alias("total"), F.avg("yhat").alias("mean"), F.max("yhat").alias("peak"),
        F.count(F.lit(1)).alias("periods"),
    )


def _order(sign: int) -> Column:
    """Value first, then the earlier date."""
    return F.struct((F.col("yhat") * sign).alias("v"), (-F.unix_date("ds")).alias("d"))


def peak_trough(forecast: DataFrame) -> DataFrame:
    """Date and value of the largest and the smallest forecast, the first one on ties."""
    return forecast.groupBy("series_key").agg(
        F.max_by("ds", _order(1)).alias("peak_ds"), F.max("yhat").alias("peak"),
        F.max_by("ds", _order(-1)).alias("trough_ds"), F.min("yhat").alias("trough"),
    )


def forecast_volatility(forecast: DataFrame) -> DataFrame:
    """Population deviation over mean; 0 for a mean that is not positive."""
    mean = F.avg("yhat")
    ratio = F.when(mean > 0, F.stddev_pop("yhat") / mean).otherwise(F.lit(0.0))
    return forecast.groupBy("series_key").agg(ratio.alias("volatility"))


def quality_gate(metrics: DataFrame, threshold: float = GATE) -> DataFrame:
    """Whether each model reaches the R² threshold, and whether the best one by RMSE does."""
    best = F.min_by("r2", F.struct("rmse", "model")).over(Window.partitionBy("series_key"))
    return metrics.select(
        "series_key", "model", "r2",
        (F.col("r2") > threshold).alias("passed"), (best > threshold).alias("series_passed"),
    )


def cross_dataset_summary(metrics: DataFrame, forecast: DataFrame) -> DataFrame:
    """Per dataset the best model by RMSE, its scores, and the mean forecast; best R² first."""
    best = metrics.groupBy("series_key").agg(
        F.min_by(F.struct("model", "rmse", "r2"), F.struct("rmse", "model")).alias("b")
    ).select("series_key", "b.*")
    mean = forecast.groupBy("series_key", "model").agg(F.avg("yhat").alias("avg_forecast"))
    return best.join(mean, ["series_key", "model"], "left").orderBy(F.desc("r2"), "series_key")
