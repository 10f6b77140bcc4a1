"""Results as text and JSON, one document per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import fixed
from panelcast.operators.metrics import forecast_summary, market_trend
from panelcast.operators.outlook import format_inr
from panelcast.operators.ranking import leaderboard_rmse, leaderboard_top_n


def _best_outlook(series: DataFrame, metrics: DataFrame, forecast: DataFrame) -> DataFrame:
    """Best model, its scores, forecast totals and market trend per series."""
    best = metrics.groupBy("series_key").agg(
        F.min_by(F.struct("model", "rmse", "mae", "r2"), F.struct("rmse", "model")).alias("b")
    ).select("series_key", "b.*")
    own = forecast.join(best.select("series_key", "model"), ["series_key", "model"])
    return (
        best.join(forecast_summary(own).drop("peak"), "series_key")
        .join(market_trend(series, own).select("series_key", "pct", "direction"), "series_key")
    )


def _as_list(leaderboard: DataFrame) -> DataFrame:
    """The ranked models of each series as one sorted array."""
    row = F.struct("rank", "model", "rmse", "mae", "r2")
    return leaderboard.groupBy("series_key").agg(
        F.sort_array(F.collect_list(row)).alias("leaderboard")
    )


def text_report(
    series: DataFrame, metrics: DataFrame, forecast: DataFrame, mode: str = "quick"
) -> DataFrame:
    """Readable summary: ``(series_key, report)``."""
    def line(label: str, value: Column) -> Column:
        return F.concat(F.rpad(F.lit(label), 17, " "), F.lit(": "), value)

    def amount(name: str) -> Column:
        return F.format_number(name, 2)

    entry = F.transform(
        "leaderboard",
        lambda m: F.format_string("%d. %-28s RMSE %15s  R2 %.4f", m["rank"], m["model"],
                                  F.format_number(m["rmse"], 2), F.round(m["r2"], 4)),
    )
    lines = [
        F.lit("SALES FORECAST REPORT"),
        line("Dataset", F.col("series_key")),
        line("Best model", F.col("model")),
        line("Mode", F.lit(mode.upper())),
        F.concat(F.lit("FORECAST SUMMARY ("), F.col("periods").cast("string"),
                 F.lit(" periods ahead)")),
        line("From", F.col("date_from").cast("string")),
        line("To", F.col("date_to").cast("string")),
        line("Total forecast", format_inr(F.col("total"), 2)),
        line("Mean per period", format_inr(F.col("mean"), 2)),
        line("Market trend", F.concat(
            fixed(F.abs("pct"), 1), F.lit("% "), F.col("direction"),
            F.lit(" than historical average"))),
        F.lit("BEST MODEL PERFORMANCE"),
        line("RMSE", amount("rmse")),
        line("MAE", amount("mae")),
        line("R2", F.format_string("%.4f", F.round("r2", 4))),  # without the sign of a zero, as in the list below
        F.lit("TOP 5 MODELS"),
        F.array_join(entry, "\n"),
    ]
    # Scores are rounded once, when they are printed, so the list says of a model what the lines above say.
    top = _as_list(leaderboard_rmse(metrics).where(F.col("rank") <= 5))
    joined = _best_outlook(series, metrics, forecast).join(top, "series_key")
    return joined.select("series_key", F.concat_ws("\n", *lines).alias("report"))


def json_result(
    series: DataFrame, metrics: DataFrame, forecast: DataFrame, recommendations: DataFrame,
    mode: str = "quick",
) -> DataFrame:
    """Structured result: ``(series_key, json)`` with scores, leaderboard and recommendations."""
    advice = recommendations.groupBy("series_key").agg(F.sort_array(F.collect_list(
        F.struct("category", "level", "title", "description", "actions"))).alias("recommendations"))
    facts = (
        _best_outlook(series, metrics, forecast)
        .join(_as_list(leaderboard_top_n(metrics, 10)), "series_key")
        .join(advice, "series_key", "left")
        .join(text_report(series, metrics, forecast, mode), "series_key")
    )
    document = F.struct(
        F.lit(True).alias("success"),
        F.col("series_key").alias("dataset"),
        F.col("model").alias("best_model"),
        *[F.round(c, 4).alias(c) for c in ("rmse", "mae", "r2")],
        F.round("total", 2).alias("total_forecast"),
        F.round("mean", 2).alias("avg_forecast"),
        F.col("periods").alias("forecast_periods"),
        F.lit(mode).alias("mode"),
        F.col("date_from"), F.col("date_to"),
        F.round(F.abs("pct"), 1).alias("market_trend_pct"),
        F.col("direction").alias("market_trend_direction"),
        F.col("report").alias("summary_text"),
        F.col("leaderboard"), F.col("recommendations"),
    )
    return facts.select("series_key", F.to_json(document).alias("json"))

