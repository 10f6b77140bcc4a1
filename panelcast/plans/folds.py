"""Expanding time folds, out-of-fold forecasts and walk-forward scoring."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.models.base import Forecaster, run_models
from panelcast.operators.series import by_key, with_position
from panelcast.session import cut_lineage

# Joins a series key and a fold number into the key of a fold's own series.
MARK = "\u0001"


def is_pooled(model: Forecaster) -> bool:
    """Whether the model learns from several series at once, so that folds must not share a fit."""
    return getattr(model, "pooled", False)


def _explode_folds(series: DataFrame, ends: Column, width: Column) -> DataFrame:
    """Rows repeated for every fold they belong to; ``ends`` are the training lengths."""
    placed = with_position(series).select(
        "series_key", "ds", "y", "pos", "n", F.posexplode(ends).alias("fold", "end")
    ).withColumn("width", width)
    part = F.when(F.col("pos") < F.col("end"), "train").otherwise("test")
    return placed.where(F.col("pos") < F.col("end") + F.col("width")).select(
        "series_key", "fold", part.alias("part"), "ds", "y",
        (F.col("pos") - F.col("end") + 1).alias("step"),
    )


def time_series_folds(series: DataFrame, k: int = 5) -> DataFrame:
    """k expanding folds per series: the last k blocks of n // (k + 1) rows are the test parts."""
    size = F.floor(F.col("n") / (k + 1)).cast("int")
    ends = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("n") - (k - i) * size)
    return _explode_folds(series, ends, size)


def calendar_folds(series: DataFrame, k: int = 5) -> DataFrame:
    """k expanding folds cut at the same dates for all series: the last k blocks of the panel's periods are the
    test parts. No series learns from dates that another one is tested on."""
    dates = series.select("ds").distinct()  # one row per calendar period
    n, pos = F.count(F.lit(1)).over(Window.partitionBy()), F.row_number().over(Window.orderBy("ds")) - 1
    size = F.floor(F.col("n") / (k + 1)).cast("int")
    block = F.when(F.col("pos") < F.col("n") - k * size, 0).otherwise(
        1 + F.floor((F.col("pos") - (F.col("n") - k * size)) / F.greatest(size, F.lit(1))))
    dated = dates.select("ds", pos.alias("pos"), n.alias("n")).select("ds", block.cast("int").alias("block"))
    # A row of block b is tested in fold b - 1 and trains the folds from b on.
    placed = series.join(dated, "ds").withColumn("fold", F.explode(F.sequence(
        F.greatest(F.col("block") - 1, F.lit(0)), F.lit(k - 1)))).where(F.col("block") <= k)
    part = F.when(F.col("block") <= F.col("fold"), "train").otherwise("test")
    step = F.row_number().over(Window.partitionBy("series_key", "fold", "part").orderBy("ds"))
    return placed.withColumn("part", part).select("series_key", "fold", "part", "ds", "y", step.alias("step"))


def _run_folds(models: Iterable[Forecaster], folds: DataFrame) -> DataFrame:
    """Forecasts of every fold: ``(series_key, fold, model, step, ds, y, yhat)``.

    Models that treat each series alone take all folds in one job, as series of their own. A pooled
    model is fitted once per fold.
    """
    keyed = cut_lineage(folds.withColumn(
        "series_key", F.concat("series_key", F.lit(MARK), F.col("fold").cast("string"))
    ))
    train = keyed.where(F.col("part") == "train").select("series_key", "ds", "y", "fold")
    test = keyed.where(F.col("part") == "test").select("series_key", "step", "ds", "y", "fold")
    models = list(models)
    alone = [m for m in models if not is_pooled(m)]
    pooled = [m for m in models if is_pooled(m)]
    future = test.drop("y")
    parts = [run_models(alone, train.drop("fold"), future.drop("fold"))] if alone else []
    count = keyed.agg(F.max("fold")).first()[0] + 1 if pooled else 0
    for i in range(count):
        one = F.col("fold") == i
        parts.append(run_models(pooled, train.where(one).drop("fold"),
                                future.where(one).drop("fold")))
    out = reduce(DataFrame.unionByName, parts)
    joined = out.select("series_key", "model", "step", "yhat").join(test, ["series_key", "step"])
    return joined.withColumn("series_key", F.substring_index("series_key", MARK, 1)).select(
        "series_key", "fold", "model", "step", "ds", "y", "yhat"
    )


def out_of_fold(models: Iterable[Forecaster], series: DataFrame, k: int = 5) -> DataFrame:
    """Forecasts of the test parts; a failed one becomes the mean of its training part. With a pooled model
    among them, the folds are cut by date."""
    models = list(models)
    cut = calendar_folds if any(map(is_pooled, models)) else time_series_folds
    folds = cut_lineage(cut(series, k))
    means = folds.where(F.col("part") == "train").groupBy("series_key", "fold").agg(
        F.avg("y").alias("_mean")
    )
    return _run_folds(models, folds).join(means, ["series_key", "fold"]).select(
        "series_key", "fold", "model", "step", "ds", "y",
        F.coalesce("yhat", "_mean").alias("yhat"),
    )


WALK_MIN = 60
WALK_WINDOW = 30
WALK_POINTS = 20


def walk_forward(
    model: Forecaster, series: DataFrame, window: int = WALK_WINDOW, step: int | None = None,
    least: int = WALK_MIN,
) -> DataFrame:
    """One-step forecasts from origins ``step`` rows apart, each after a refit:
    ``(series_key, ds, y, yhat, ape)``. The first origin has ``window`` rows, or a quarter of a shorter
    series; without ``step`` there are about twenty origins. Series of at most ``least`` rows are left
    out; ``walk_status`` names them.

    All origins of all series run together, each as a series of its own that ends at the origin.
    """
    n = F.col("n")
    first = F.least(F.lit(window), F.floor(n / 4).cast("int"))
    gap = F.lit(step) if step else F.greatest(
        F.lit(1), F.floor((n - first) / WALK_POINTS).cast("int"))
    sized = series.withColumn("_n", F.count(F.lit(1)).over(by_key())).where(
        F.col("_n") > least
    ).drop("_n")
    ends = F.sequence(first, n - 1, gap)
    folds = _explode_folds(sized, ends, F.lit(1))
    scored = _run_folds([model], folds)
    ape = F.abs(F.col("y") - F.col("yhat")) / (F.col("y") + F.lit(1e-9)) * 100
    return scored.where(F.col("yhat").isNotNull()).select(
        "series_key", "ds", "y", "yhat", ape.alias("ape")
    )


def walk_status(series: DataFrame, least: int = WALK_MIN) -> DataFrame:
    """``scored`` or ``too short`` per series."""
    return series.groupBy("series_key").agg(F.count(F.lit(1)).alias("n")).select(
        "series_key", F.when(F.col("n") > least, "scored").otherwise("too short").alias("status"))


def walk_forward_accuracy(walk: DataFrame) -> DataFrame:
    return walk.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("origins"), F.avg("ape").alias("mape")
    )
