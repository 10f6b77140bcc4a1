"""Leaderboards and selections over metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _rank(metrics: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy(*order)
    return metrics.withColumn("rank", F.row_number().over(w))


def leaderboard_rmse(metrics: DataFrame) -> DataFrame:
    return _rank(metrics, "rmse", "model")


def leaderboard_r2(metrics: DataFrame) -> DataFrame:
    """Best R² first; by RMSE when there is no R²."""
    if "r2" not in metrics.columns:
        return leaderboard_rmse(metrics)
    return _rank(metrics, F.desc("r2"), "model")


def leaderboard_top_n(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The n best models by RMSE, scores with four digits."""
    top = leaderboard_rmse(metrics).where(F.col("rank") <= n)
    return top.select("series_key", "rank", "model",
                      *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")])


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Long table of RMSE, MAE and R² with the place of each model under each."""
    long = metrics.unpivot(["series_key", "model"], ["rmse", "mae", "r2"], "metric", "value")
    goodness = F.when(F.col("metric") == "r2", -F.col("value")).otherwise(F.col("value"))
    w = Window.partitionBy("series_key", "metric").orderBy(goodness, "model")
    return long.withColumn("rank", F.row_number().over(w))


def best_model(metrics: DataFrame) -> DataFrame:
    """The model with the smallest RMSE of each series."""
    return metrics.groupBy("series_key").agg(
        F.min_by(F.struct("model", "rmse", "r2"), F.struct("rmse", "model")).alias("b")
    ).select("series_key", "b.*")


def union_metrics(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
