"""The forecasters available for benchmarking, by id."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelcast.models import perseries as P
from panelcast.models import pooled as R
from panelcast.models.autoregressive import AR
from panelcast.models.base import CUSTOM, Forecaster
from panelcast.models.baseline import Naive, SeasonalNaive
from panelcast.models.smoothing import HoltWinters
from panelcast.models.wrappers import Differenced
from panelcast.operators.diagnostics import optimal_lags
from panelcast.spec import season_length

DEFAULT_LAGS = 14
# Ids of the quick benchmark, in the order of the full one.
QUICK = (
    "naive", "seasonal_naive", "ar", "holt_winters", "linear", "differenced", "ridge",
    "random_forest", "gbt", "hist_gbt", "xgb_preset", "lgbm_preset", "catboost_preset", "mlp",
)


def panel_lags(series: DataFrame) -> int:
    """Lag count of a panel: the largest that any of its series asks for."""
    row = optimal_lags(series).agg({"lags": "max"}).first()
    return int(row[0] or DEFAULT_LAGS)


def full_registry(
    lags: int = DEFAULT_LAGS, freq: str = "D", trees: int | None = None, season: int | None = None
) -> dict[str, Forecaster]:
    """All forecasters. ``trees`` replaces the number of trees of every ensemble; the boosted presets
    carry the settings and ways of growing of three boosting libraries."""
    season = season or season_length(freq)

    def pooled(id: str, name: str, solve, log: bool = True, **options) -> R.PooledRegressor:
        if trees and options.get("trees", 1) > 1:
            options["trees"] = trees
        return R.PooledRegressor(id, name, solve, lags, log, options=options)

    linear = pooled("linear", "Linear Regression", R.solve_linear)
    signed = R.PooledRegressor("linear", "Linear Regression", R.solve_linear, lags, signed=True)
    models: list[Forecaster] = [
        Naive(),
        SeasonalNaive(season),
        AR(lags),
        HoltWinters(season=season),
        linear,
        Differenced(signed),
        pooled("ridge", "Ridge", R.solve_ridge, alpha=1.0),
        pooled("lasso", "Lasso", R.solve_lasso, alpha=0.01),
        pooled("elasticnet", "ElasticNet", R.solve_elasticnet, alpha=0.01, ratio=0.5),
        pooled("bayesian_ridge", "Bayesian Ridge", R.solve_bayesian_ridge),
        pooled("huber", "Huber Regressor", R.solve_huber),
        pooled("decision_tree", "Decision Tree", R.solve_ensemble, boost=False, trees=1, depth=8),
        P.PerSeriesRegressor("knn", "KNN", P.fit_knn, lags, options={"k": 5}),
        pooled("svr_rff", "SVR (RBF)", R.solve_fourier, log=False),
        pooled("extra_trees", "Extra Trees", R.solve_ensemble, boost=False, trees=200, depth=12, cut="random"),
        pooled("random_forest", "Random Forest", R.solve_ensemble, boost=False, trees=300, depth=10, leaf=5,
               sample="bootstrap"),
        pooled("gbt", "Gradient Boosting", R.solve_ensemble, trees=300, rate=0.03, depth=4, leaf=5, rows=0.8),
        pooled("hist_gbt", "HistGradientBoosting", R.solve_ensemble, trees=300, rate=0.03, depth=5, leaf=5, l2=0.1,
               growth="leaf", leaves=31),
        pooled("xgb_preset", "XGBoost", R.solve_ensemble, trees=500, rate=0.02, depth=5, leaf=5, l2=1.0, rows=0.8,
               columns=0.8),
        pooled("lgbm_preset", "LightGBM", R.solve_ensemble, trees=500, rate=0.02, depth=5, leaf=10, rows=0.8,
               columns=0.8, growth="leaf", leaves=31),
        pooled("catboost_preset", "CatBoost", R.solve_ensemble, trees=800, rate=0.03, depth=6, l2=3.0,
               growth="symmetric", sample="bayesian"),
        P.PerSeriesRegressor("mlp", "MLP Neural Network", P.fit_mlp, lags),
    ]
    return {**{m.id: m for m in models}, **CUSTOM}


def quick_registry(**settings) -> dict[str, Forecaster]:
    full = full_registry(**settings)
    return {k: m for k, m in full.items() if k in QUICK or k in CUSTOM}
