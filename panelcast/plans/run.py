"""The whole run over a panel: build, benchmark, choose, refit, forecast, advise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.models.registry import full_registry, panel_lags, quick_registry
from panelcast.operators.insight import insight_rules
from panelcast.operators.metrics import forecast_metrics
from panelcast.operators.ranking import best_model
from panelcast.operators.series import (
    build_series,
    clean_sales,
    MIN_PERIODS,
    require_rows,
    split_usable,
    train_test,
)
from panelcast.plans.backtest import backtest, refit_on_full
from panelcast.plans.ensemble import Stacking, WeightedEnsemble
from panelcast.plans.tune import GRIDS, tune_random_search
from panelcast.session import cut_lineage
from panelcast.spec import FREQUENCIES, SeriesSpec

POOR, FAIR = 0.1, 0.7
TO_WEEKLY = "switch to weekly aggregation"
TO_MONTHLY = "switch to monthly aggregation"
CHECK_DATA = "check the data for outliers or add history"
TUNE = "enable hyper-parameter tuning"


def adaptive_frequency(best: DataFrame, freq: str, tuned: bool = False) -> DataFrame:
    """What to change for series whose best R² is poor: ``(series_key, r2, rerun, advice)``.

    ``rerun`` marks daily series that should be aggregated and run again by week.
    """
    poor = F.col("r2") < POOR
    coarser = {"D": TO_WEEKLY, "W": TO_MONTHLY, "MS": CHECK_DATA}.get(freq)
    advice: list[Column] = []
    if coarser:
        advice.append(F.when(poor, F.lit(coarser)))
    if not tuned:
        advice.append(F.when(F.col("r2") < FAIR, F.lit(TUNE)))
    texts = F.array_compact(F.array(*advice)) if advice else F.array().cast("array<string>")
    return best.select(
        "series_key", "r2", (poor & F.lit(freq == "D")).alias("rerun"), texts.alias("advice")
    )


@dataclass(frozen=True)
class PanelResult:
    """Frames of one run. ``rejected`` holds the series too short to model."""

    freq: str
    series: DataFrame
    rejected: DataFrame
    metrics: DataFrame
    best: DataFrame
    forecast: DataFrame
    advice: DataFrame

    def recommendations(self, as_of: Column) -> DataFrame:
        return insight_rules(self.series, self.forecast, as_of)


def _nothing(freq: str, series: DataFrame, rejected: DataFrame) -> PanelResult:
    """Result of a panel without a series long enough to model."""
    spark = series.sparkSession
    scored = spark.createDataFrame([], "series_key string, model string, step int, ds date, y double, yhat double")
    metrics = forecast_metrics(scored)
    best = best_model(metrics)
    return PanelResult(freq, series, rejected, metrics, best, scored.drop("y"), adaptive_frequency(best, freq))


def run_rows(
    rows: DataFrame, freq: str, periods: int = 30, mode: str = "quick", tune: bool = False,
    combine: bool = True, models: dict | None = None, trees: int | None = None,
    lags: int | None = None, min_periods: int = MIN_PERIODS,
) -> PanelResult:
    """Run from transaction rows ``(series_key, ds, y)``. Without ``lags`` the panel's largest significant lag
    counts for all its series; with it a series does not depend on the others."""
    usable, rejected = split_usable(build_series(rows, freq), min_periods)
    series = cut_lineage(usable)
    if series.isEmpty():
        return _nothing(freq, series, rejected)
    if models is None:
        registry = full_registry if mode == "full" else quick_registry
        models = registry(lags=lags or panel_lags(series), freq=freq, trees=trees)
    if tune:
        train, _ = train_test(series)
        models = {k: tune_random_search(m, train)[0] if k in GRIDS else m
                  for k, m in models.items()}
    runners = list(models.values())
    if combine and len(runners) >= 2:
        extra = [WeightedEnsemble(runners)] + ([Stacking(runners)] if len(runners) >= 3 else [])
        runners += extra
    metrics = cut_lineage(backtest(runners, series))
    best = best_model(metrics)
    forecast = cut_lineage(
        refit_on_full(runners, series, best.select("series_key", "model"), periods, freq)
    )
    return PanelResult(freq, series, rejected, metrics, best, forecast,
                       adaptive_frequency(best, freq, tune))


def run_panel(df: DataFrame, spec: SeriesSpec, periods: int = 30, **settings) -> PanelResult:
    """Run from a raw sales table and its specification."""
    return run_rows(require_rows(clean_sales(df, spec)), spec.freq, periods, **settings)


def run_adaptive(rows: DataFrame, freq: str, periods: int = 30, **settings) -> list[PanelResult]:
    """A run, and a second one by week over the daily series that came out poorly."""
    first = run_rows(rows, freq, periods, **settings)
    flagged = first.advice.where("rerun").select("series_key")
    if freq != "D" or flagged.isEmpty():
        return [first]
    again = rows.join(flagged, "series_key", "left_semi")
    return [first, run_rows(again, "W", periods, **settings)]


def run_all_datasets(datasets: dict[str, DataFrame], freq: str, **settings) -> PanelResult:
    """Several datasets as one panel and one run, the dataset name leading the series key."""
    rows = None
    for name, df in datasets.items():
        keyed = df.withColumn("series_key", F.concat(F.lit(f"{name}/"), F.col("series_key")))
        rows = keyed if rows is None else rows.unionByName(keyed)
    return run_rows(rows, freq, **settings)


@dataclass(frozen=True)
class DatasetsResult:
    """What several datasets came to. ``best`` and ``forecast`` lead with ``dataset`` and ``freq``; ``status`` has a
    row per dataset: ``ok``, ``too short`` or ``failed``, with the ``reason`` of a failure."""

    best: DataFrame
    forecast: DataFrame
    status: DataFrame


def dataset_of(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def run_datasets(
    datasets: dict[str, tuple[DataFrame | Callable[[], DataFrame], str]], periods: int = 30,
    models: Callable[[str], dict] | None = None, **settings,
) -> DatasetsResult:
    """Datasets of different frequencies in one go.

    Each dataset comes as its rows ``(series_key, ds, y)``, or a function that reads them, and its frequency.
    Datasets of equal frequency are one panel and one run, so there are at most as many runs as frequencies.
    A dataset that cannot be read, or whose panel cannot be run, fails alone. ``models`` gives the forecasters
    of a frequency.
    """
    if not datasets:
        raise ValueError("no datasets")
    reasons: dict[str, str] = {}
    panels: dict[str, dict[str, DataFrame]] = {}
    for name, (rows, freq) in datasets.items():
        try:
            if freq not in FREQUENCIES or "/" in name:
                raise ValueError(f"unknown frequency {freq!r}" if "/" not in name else "a dataset's name holds a slash")
            df = rows() if callable(rows) else rows
            panels.setdefault(freq, {})[name] = df.select(
                F.concat(F.lit(f"{name}/"), F.col("series_key")).alias("series_key"), "ds", "y")
        except Exception as error:  # noqa: BLE001 - one dataset must not stop the others
            reasons[name] = str(error).strip().splitlines()[0][:200]

    def run(freq: str, rows: DataFrame) -> PanelResult:
        return run_rows(rows, freq, periods, models=models(freq) if models else None, **settings)

    done: list[PanelResult] = []
    for freq, members in panels.items():
        try:
            done.append(run(freq, reduce(DataFrame.unionByName, members.values())))
        except Exception:  # noqa: BLE001 - find out which one it was
            for name, rows in members.items():
                try:
                    done.append(run(freq, rows))
                except Exception as error:  # noqa: BLE001
                    reasons[name] = str(error).strip().splitlines()[0][:200]
    spark = SparkSession.active()
    listed = spark.createDataFrame([(n, f, reasons.get(n)) for n, (_, f) in datasets.items()],
                                   "dataset string, freq string, reason string")
    if not done:
        keyed = "dataset string, freq string, series_key string, model string"
        return DatasetsResult(spark.createDataFrame([], keyed), spark.createDataFrame([], keyed),
                              listed.select("dataset", "freq", F.lit("failed").alias("status"), "reason"))

    def all_of(part: Callable[[PanelResult], DataFrame]) -> DataFrame:
        keyed = [part(r).withColumns({"dataset": dataset_of(F.col("series_key")), "freq": F.lit(r.freq)}) for r in done]
        return reduce(DataFrame.unionByName, keyed)

    best, forecast = all_of(lambda r: r.best), all_of(lambda r: r.forecast)
    modelled = all_of(lambda r: r.series.select("series_key")).groupBy("dataset").agg(F.lit(True).alias("modelled"))
    made = forecast.groupBy("dataset").agg(F.bool_or(F.col("yhat").isNotNull()).alias("made"))
    state = F.when(F.col("reason").isNotNull(), "failed").when(F.col("made"), "ok").when(
        F.col("modelled"), "failed").otherwise("too short")
    status = listed.join(modelled, "dataset", "left").join(made, "dataset", "left").select(
        "dataset", "freq", state.alias("status"), "reason")
    return DatasetsResult(best, forecast, status)
