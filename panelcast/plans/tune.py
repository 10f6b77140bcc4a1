"""Random search over hyper-parameters with expanding time folds."""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.binned import TreeSettings, bin_panel, fit_ensembles, held_out_errors
from panelcast.models.gram import Gram, elastic_net, grams, ridge
from panelcast.models.pooled import PooledRegressor, training_frame
from panelcast.operators.features import EVERY, model_names
from panelcast.operators.series import with_position

SEED = 42
FOLDS = 2
MAX_POINTS = 20

_BOOST = {"trees": [300, 500, 800], "rate": [0.01, 0.03, 0.05, 0.1], "depth": [3, 4, 5, 6],
          "rows": [0.7, 0.8, 0.9], "columns": [0.7, 0.8, 0.9]}
# The search grid of each model, by its id.
GRIDS: dict[str, dict[str, list]] = {
    "xgb_preset": _BOOST,
    "lgbm_preset": _BOOST,
    "catboost_preset": {"trees": [300, 500, 800], "rate": [0.01, 0.03, 0.05], "depth": [4, 5, 6]},
    "random_forest": {"trees": [100, 200, 300], "depth": [30, 10, 20], "leaf": [1, 5, 10]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "lasso": {"alpha": [1e-4, 1e-3, 0.01, 0.1, 1.0]},
    "elasticnet": {"alpha": [0.001, 0.01, 0.1, 1.0], "ratio": [0.2, 0.5, 0.8]},
}
SEARCH_SCHEMA = "model string, params string, mae double"


def sample_grid(grid: dict[str, list], points: int = MAX_POINTS) -> list[dict]:
    """Up to ``points`` different grid points, always the same ones."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    return every if len(every) <= points else random.Random(SEED).sample(every, points)


def fold_rows(frame: DataFrame, k: int = FOLDS) -> DataFrame:
    """Feature rows with the block they lie in: block i tests fold i − 1 and trains later folds."""
    size = F.floor(F.col("n") / (k + 1)).cast("int")
    first = F.col("n") - size * k
    block = F.when(F.col("pos") < first, 0).otherwise(
        1 + F.floor((F.col("pos") - first) / F.greatest(size, F.lit(1)))
    )
    return with_position(frame).withColumn("block", block.cast("int")).drop("pos", "n")


def _solve(model: str, g: Gram, params: dict) -> tuple[np.ndarray, float]:
    if model == "ridge":
        return g.plain(ridge(g, params["alpha"]))
    ratio = 1.0 if model == "lasso" else params["ratio"]
    return g.plain(elastic_net(g, params["alpha"], ratio))


def _linear_scores(
    model: str, rows: DataFrame, names: list[str], points: list[dict], k: int
) -> list[float]:
    """Mean error of all points from two passes: one for the Gram of each fold, one to score."""
    # A row of block b trains the folds b, b+1, ...; fold i is tested on block i + 1.
    exploded = rows.where(F.col("block") < k).withColumn(
        "fold", F.explode(F.sequence(F.col("block"), F.lit(k - 1)))
    )
    by_fold = grams(exploded, names, "fold")
    fits = [[_solve(model, by_fold[i], p) for p in points] for i in range(k)]
    weights = [np.column_stack([w for w, _ in f]) for f in fits]
    offsets = [np.array([b for _, b in f]) for f in fits]

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, part in batch.groupby("block"):
                p = part[names].to_numpy(dtype=float) @ weights[block - 1] + offsets[block - 1]
                miss = np.abs(part["y"].to_numpy(dtype=float)[:, None] - p).sum(axis=0)
                yield pd.DataFrame({"fold": block - 1, "point": np.arange(len(points)),
                                    "miss": miss, "rows": len(part)})

    tested = rows.where(F.col("block") > 0).select("block", "y", *names)
    sums = tested.mapInPandas(errors, "fold int, point int, miss double, rows long").groupBy(
        "fold", "point").agg((F.sum("miss") / F.sum("rows")).alias("mae"))
    means = sums.groupBy("point").agg(F.avg("mae").alias("mae")).collect()
    return [m for _, m in sorted((r["point"], r["mae"]) for r in means)]


def _tree_scores(
    model: PooledRegressor, rows: DataFrame, names: list[str], points: list[dict], k: int
) -> list[float]:
    """Errors of tree ensembles. Points that are stages of the same trees are grown once, and all fits are
    tasks of one job; a panel of several partitions is fitted and scored point by point."""
    settings = [TreeSettings(**{**model.options, **p}) for p in points]
    panel = bin_panel(rows, names, mark="block")
    try:
        if panel.parts == 1:
            return held_out_errors(panel, settings, k)
    finally:
        panel.unpersist()
    context = rows.sparkSession.sparkContext
    total = [0.0] * len(points)
    for i in range(k):
        binned = bin_panel(rows.where(F.col("block") <= i), names)
        test = rows.where(F.col("block") == i + 1).select("y", *names)
        for j, (predictor, _) in enumerate(fit_ensembles(binned, settings)):
            shared = context.broadcast(predictor)

            def errors(
                batches: Iterator[pd.DataFrame], shared=shared
            ) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    p = shared.value(batch[names].to_numpy(dtype=float))
                    yield pd.DataFrame({"miss": np.abs(batch["y"].to_numpy(dtype=float) - p)})

            total[j] += test.mapInPandas(errors, "miss double").agg(F.avg("miss")).first()[0] / k
        binned.unpersist()
    return total


def tune_random_search(
    model: PooledRegressor, series: DataFrame, points: list[dict] | None = None, k: int = FOLDS
) -> tuple[PooledRegressor, DataFrame]:
    """The model with its best grid point, and the score of every point tried.

    Scores are mean absolute one-step errors on the scale the model works in. A model without a grid
    comes back unchanged.
    """
    spark = series.sparkSession
    if model.id not in GRIDS:
        return model, spark.createDataFrame([], SEARCH_SCHEMA)
    points = points or sample_grid(GRIDS[model.id])
    names = model_names(model.lags, EVERY)
    rows = fold_rows(training_frame(series, model.lags, EVERY, model.log, model.warmup), k)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if model.id in ("ridge", "lasso", "elasticnet"):
            scores = _linear_scores(model.id, rows, names, points, k)
        else:
            scores = _tree_scores(model, rows, names, points, k)
    finally:
        rows.unpersist()
    table = [(model.id, json.dumps(p, sort_keys=True), float(s))
             for p, s in zip(points, scores, strict=True)]
    best = min(zip(scores, range(len(points)), strict=True))[1]
    return model.with_options(**points[best]), spark.createDataFrame(table, SEARCH_SCHEMA)
