"""Hold-out scoring of forecasters, and the forecast of the winner."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import not_negative
from panelcast.models.base import Forecaster, run_models
from panelcast.operators.metrics import actual_vs_predicted, forecast_metrics
from panelcast.operators.outlook import future_index
from panelcast.operators.series import train_test
from panelcast.plans.folds import is_pooled
from panelcast.session import cut_lineage


def score_holdout(
    models: Iterable[Forecaster], series: DataFrame, train_ratio: float = 0.8
) -> DataFrame:
    """Predictions of the last fifth of each series: ``(series_key, model, step, ds, y, yhat)``."""
    models = list(models)
    if len(models) > 1:
        series = cut_lineage(series)
    train, test = train_test(series, train_ratio)
    return actual_vs_predicted(test, run_models(models, train, test.drop("y")))


def backtest(
    models: Iterable[Forecaster], series: DataFrame, train_ratio: float = 0.8
) -> DataFrame:
    """Metrics per series and model. A model that failed on a series has no row there."""
    scored = score_holdout(models, series, train_ratio)
    return forecast_metrics(scored.where(F.col("yhat").isNotNull()))


def refit_on_full(
    models: Iterable[Forecaster], series: DataFrame, winners: DataFrame, periods: int, freq: str
) -> DataFrame:
    """Each series forecast by its winning model, fitted on all of its rows.

    ``winners`` has ``(series_key, model)``. A model that learns from several series at once is fitted on
    all of them, as it was when it was scored, and forecasts the series it won. Where a winner fails, its
    forecast is null.
    """
    series, winners = cut_lineage(series), cut_lineage(winners)
    future = future_index(series, periods, freq)
    parts = []
    present = {r[0] for r in winners.select("model").distinct().collect()}
    for m in (m for m in models if m.id in present):
        won = winners.where(F.col("model") == m.id).select("series_key")
        mine = future.join(won, "series_key", "left_semi")
        if is_pooled(m):
            out = run_models([m], series, mine)
        else:
            out = run_models([m], series.join(won, "series_key", "left_semi"), mine)
        parts.append(out.select("series_key", F.lit(m.id).alias("model"), "step", "ds",
                                not_negative(F.col("yhat")).alias("yhat")))
    return reduce(DataFrame.unionByName, parts)
