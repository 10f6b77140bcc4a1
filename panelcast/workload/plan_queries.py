"""Queries over regressors, folds, ensembles, tuning and whole runs."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.models.autoregressive import AR, AR1
from panelcast.models.base import CUSTOM, CustomForecaster, register_forecaster, run_models
from panelcast.models.baseline import Naive, SeasonalNaive
from panelcast.models.perseries import knn_one_step, neighbor_join, register_estimator
from panelcast.models.registry import full_registry, quick_registry
from panelcast.models.smoothing import HoltWinters
from panelcast.operators import features as X
from panelcast.operators import outlook as O
from panelcast.operators import ranking as R
from panelcast.operators.metrics import forecast_metrics
from panelcast.operators.series import split_point, train_test, with_position
from panelcast.plans import ensemble as E
from panelcast.plans import folds as L
from panelcast.plans.backtest import backtest, score_holdout
from panelcast.plans.run import adaptive_frequency, run_all_datasets, run_datasets, run_rows
from panelcast.plans.tune import tune_random_search
from panelcast.session import cut_lineage, shared_folder
from panelcast.spec import season_length
from panelcast.streaming.answers import forecast_answers
from panelcast.streaming.requests import request_stream
from panelcast.sources.model_store import load_forecaster, load_model, save_forecaster, save_model
from panelcast.sources.tables import read_sales_table
from panelcast.workload.base import (
    BRAND_MONTHLY,
    EVENT_DAILY,
    NATION_WEEKLY,
    PLACED,
    brand_monthly,
    global_daily,
    nation_rows,
    nation_weekly,
    query,
    rsql,
    series_sql,
)
from panelcast.workload.feature_queries import matrix_sql
from panelcast.workload.model_queries import SEASON, ar_sql, baselines, baselines_sql
from panelcast.workload.score_queries import METRICS, STEPS, metrics_sql
from panelcast.workload.source_queries import _MESSAGES, _fresh, _messages


def _regressor_query(key: str, model: str) -> None:
    """Hold-out forecasts of one registered model on the weekly panel."""
    def run(spark, folder):
        chosen = full_registry(freq="W")[model]
        train, test = train_test(cut_lineage(nation_weekly(spark, folder)))
        return chosen.forecast(train, test.drop("y"))

    query(key)(run)


for _id in ("linear", "ridge", "lasso", "elasticnet", "bayesian_ridge", "huber", "decision_tree",
            "random_forest", "extra_trees", "gbt", "hist_gbt", "xgb_preset", "lgbm_preset",
            "catboost_preset", "svr_rff", "mlp", "differenced"):
    _regressor_query(f"model_{_id}", _id)


@query("model_knn_recursive")
def _(spark, folder):
    train, test = train_test(cut_lineage(nation_weekly(spark, folder)))
    return full_registry(freq="W")["knn"].forecast(train, test.drop("y"))


@query("model_feature_recursive")
def _(spark, folder):
    """Global daily series: a fit per series and a fit over the panel are the same thing here."""
    series = cut_lineage(global_daily(spark, folder))
    return full_registry(freq="D")["ridge"].forecast(series, O.future_index(series, 30, "D"))


# --- neighbours --------------------------------------------------------------------------------

_NEAR = [f"lag_{k}" for k in range(1, 8)] + ["sin_1", "cos_1"]
_DIST = " + ".join(f"pow((q.{c} - t.{c}) / m.sd_{c}, 2)" for c in _NEAR)
_NEIGHBORS = f"""{matrix_sql()},
rows2 AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS pos,
  count(*) OVER (PARTITION BY series_key) AS n FROM matrix),
known AS (SELECT * FROM rows2 WHERE pos < floor(n * CAST(0.8 AS DOUBLE))),
asked AS (SELECT * FROM rows2 WHERE pos >= floor(n * CAST(0.8 AS DOUBLE))),
m AS (SELECT series_key, {", ".join(f"stddev_pop({c}) AS sd_{c}" for c in _NEAR)} FROM known GROUP BY 1),
pairs AS (SELECT q.series_key, q.ds, t.ds AS neighbor_ds, t.y, sqrt({_DIST}) AS distance
  FROM asked q JOIN known t ON t.series_key = q.series_key JOIN m ON m.series_key = q.series_key),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key, ds ORDER BY distance, neighbor_ds)
  AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5)"""


def _neighbors(spark, folder):
    frame = with_position(X.feature_matrix(cut_lineage(nation_weekly(spark, folder)), 14))
    cut = split_point(F.col("n"))
    known, asked = frame.where(F.col("pos") < cut), frame.where(F.col("pos") >= cut)
    return neighbor_join(known, asked, _NEAR, 5)


@query("neighbor_join", f"""WITH {_NEIGHBORS} SELECT series_key, ds, rank, neighbor_ds,
{rsql('distance', 6, 'distance')}, {rsql('y', 4, 'y')} FROM near""")
def _(spark, folder):
    out = _neighbors(spark, folder)
    return out.withColumn("distance", rnd(F.col("distance"))).withColumn("y", rnd(F.col("y"), 4))


@query("model_knn", f"""WITH {_NEIGHBORS}, w AS (SELECT *, max(CASE WHEN distance = 0 THEN 1 ELSE 0 END)
  OVER (PARTITION BY series_key, ds) AS exact FROM near)
SELECT series_key, ds, {rsql('''sum(y * CASE WHEN exact = 1 THEN CASE WHEN distance = 0 THEN 1 ELSE 0 END
  ELSE 1 / distance END) / sum(CASE WHEN exact = 1 THEN CASE WHEN distance = 0 THEN 1 ELSE 0 END
  ELSE 1 / distance END)''', 2, 'yhat')} FROM w GROUP BY 1, 2""")
def _(spark, folder):
    return knn_one_step(_neighbors(spark, folder)).withColumn("yhat", rnd(F.col("yhat"), 2))


# --- importance, registry, persistence -----------------------------------------------------------

def _forest(spark, folder):
    return full_registry(freq="W")["random_forest"].fit(
        cut_lineage(nation_weekly(spark, folder)))


@query("feature_importance")
def _(spark, folder):
    return _forest(spark, folder).feature_importance(spark)


@query("top_features")
def _(spark, folder):
    return R.top_features(_forest(spark, folder).feature_importance(spark), 20)


@query("save_model")
def _(spark, folder):
    series = cut_lineage(nation_weekly(spark, folder))
    fitted = full_registry(freq="W")["ridge"].fit(series)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    save_model(spark, fitted, path)
    future = O.future_index(series, STEPS, "W")
    return load_model(spark, path).forecast(series, future)


@query("load_model")
def _(spark, folder):
    """One model of every kind, and an ensemble of some, fitted, stored, and forecasting from the store."""
    series = cut_lineage(nation_weekly(spark, folder))
    models = full_registry(freq="W")
    some = [models[k] for k in ("naive", "seasonal_naive", "ar", "holt_winters", "differenced", "ridge", "knn")]
    where, future = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}", O.future_index(series, STEPS, "W")
    parts = []
    for model in [*some, E.WeightedEnsemble(baselines()), E.Stacking(baselines())]:
        save_forecaster(model, series, where, "nation_weekly")
        out = load_forecaster(model, where, "nation_weekly").forecast(future)
        parts.append(out.select("series_key", F.lit(model.id).alias("model"), "step", "ds", "yhat"))
    return reduce(DataFrame.unionByName, parts)


def _registry_query(name: str, registry) -> None:
    """Scores of every member of the registry, with the ids of members that fail."""
    def run(spark, folder):
        models = registry(freq="W")
        scores = backtest(models.values(), nation_weekly(spark, folder))
        names = spark.createDataFrame([(k, m.name) for k, m in models.items()],
                                      "model string, name string")
        return names.join(scores, "model", "left")

    query(name)(run)


_registry_query("model_registry_full", full_registry)
_registry_query("model_registry_quick", quick_registry)


def _drift(history, steps):
    """A user's model: the straight line through the first and last value."""
    y = history["y"].to_numpy()
    slope = (y[-1] - y[0]) / max(len(y) - 1, 1)
    return np.maximum(y[-1] + slope * steps["step"].to_numpy(), 0.0)


@query("register_forecaster", f"""WITH {NATION_WEEKLY}, {PLACED},
cutoff AS (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS INTEGER) AS cut FROM placed),
e AS (SELECT series_key, max(CASE WHEN pos = 0 THEN y END) AS y0,
  max(CASE WHEN pos = cut - 1 THEN y END) AS y1, max(cut) AS cut FROM cutoff GROUP BY 1)
SELECT c.series_key, CAST(pos - c.cut + 1 AS INTEGER) AS step, ds,
{rsql('greatest(y1 + (y1 - y0) / (c.cut - 1) * (pos - c.cut + 1), CAST(0 AS DOUBLE))', 4, 'yhat')}
FROM cutoff c JOIN e USING (series_key) WHERE pos >= c.cut""")
def _(spark, folder):
    train, test = train_test(cut_lineage(nation_weekly(spark, folder)))
    register_forecaster(CustomForecaster("drift", "Drift", _drift))
    try:
        model = full_registry(freq="W")["drift"]
    finally:
        CUSTOM.pop("drift")  # other queries of the session run the plain registry
    out = model.forecast(train, test.drop("y"))
    return out.withColumn("yhat", rnd(F.col("yhat"), 4))


# --- folds and walk-forward ----------------------------------------------------------------------

def _folds_sql(k: int) -> str:
    return f"""{PLACED}, f AS (SELECT *, CAST(unnest(range(0, {k})) AS INTEGER) AS fold FROM placed),
b AS (SELECT *, n - ({k} - fold) * (n // {k + 1}) AS fin, n // {k + 1} AS width FROM f),
folds AS (SELECT series_key, fold, CASE WHEN pos < fin THEN 'train' ELSE 'test' END AS part, ds, y,
  CAST(pos - fin + 1 AS INTEGER) AS step, pos, fin FROM b WHERE pos < fin + width)"""


@query("time_series_folds", f"""WITH {NATION_WEEKLY}, {_folds_sql(5)}
SELECT series_key, fold, part, ds, step FROM folds""")
def _(spark, folder):
    out = L.time_series_folds(nation_weekly(spark, folder), 5)
    return out.select("series_key", "fold", "part", "ds", F.col("step").cast("int").alias("step"))


@query("out_of_fold", f"""WITH {NATION_WEEKLY}, {_folds_sql(5)}, a AS (SELECT series_key, fold,
  avg(y) AS yhat FROM folds WHERE part = 'train' AND pos >= fin - 7 GROUP BY 1, 2)
SELECT series_key, fold, step, ds, {rsql('yhat', 2, 'yhat')} FROM folds JOIN a USING (series_key, fold)
WHERE part = 'test'""")
def _(spark, folder):
    out = L.out_of_fold([Naive()], nation_weekly(spark, folder))
    return out.select("series_key", "fold", "step", "ds", rnd(F.col("yhat"), 2).alias("yhat"))


def _walk_sql(prediction: str) -> str:
    return f"""WITH {NATION_WEEKLY}, {PLACED},
o AS (SELECT *, least(30, n // 4) AS w FROM placed WHERE n > 60),
s AS (SELECT *, greatest(1, (n - w) // 20) AS st, {prediction} AS yhat FROM o),
walk AS (SELECT *, abs(y - yhat) / (y + 1e-9) * 100 AS ape FROM s
  WHERE pos >= w AND (pos - w) % st = 0)
SELECT series_key, count(*) AS origins, {rsql('log10(avg(ape) + 1)', 6, 'mape')} FROM walk GROUP BY 1"""


def _walk(model):
    def run(spark, folder):
        walk = L.walk_forward(model, nation_weekly(spark, folder))
        # Weeks without sales make the mean error astronomically large; its logarithm is compared.
        out = L.walk_forward_accuracy(walk)
        return out.withColumn("mape", rnd(F.log10(F.col("mape") + 1), 6))

    return run


query("walk_forward_accuracy", _walk_sql(
    "avg(y) OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
))(_walk(Naive()))
query("walk_forward_seasonal", _walk_sql(
    f"greatest(lag(y, {SEASON}) OVER (PARTITION BY series_key ORDER BY ds), 0)"
))(_walk(SeasonalNaive(SEASON)))


# Every origin is a series of its own that ends there. Weeks without sales make errors astronomically
# large; their logarithm is compared.
@query("walk_forward_ar", f"""WITH RECURSIVE {NATION_WEEKLY}, {PLACED},
o AS (SELECT *, least(30, n // 4) AS w FROM placed WHERE n > 60),
origins AS (SELECT *, series_key || '#' || pos AS name FROM o WHERE pos >= w AND (pos - w) % greatest(1, (n - w) // 20) = 0),
train AS (SELECT g.name AS series_key, p.ds, p.y, p.pos, g.pos AS n FROM origins g
  JOIN placed p ON p.series_key = g.series_key AND p.pos < g.pos),
test AS (SELECT name AS series_key, 1 AS step, ds FROM origins), {ar_sql(7, 1)}
SELECT g.series_key, g.ds, {rsql('y', 4, 'y')}, {rsql('yhat', 0, 'yhat')},
{rsql('log10(abs(y - yhat) / (y + 1e-9) * 100 + 1)', 6, 'ape')} FROM origins g JOIN ar ON ar.series_key = g.name""")
def _(spark, folder):
    out = L.walk_forward(AR(7), nation_weekly(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("y"), 4).alias("y"), rnd(F.col("yhat"), 0).alias("yhat"),
                      rnd(F.log10(F.col("ape") + 1), 6).alias("ape"))


# --- ensembles -----------------------------------------------------------------------------------

_VALIDATION = f"""{PLACED}, cutoff AS (SELECT *, n - greatest(7, CAST(floor(n * CAST(0.15 AS DOUBLE))
  AS INTEGER)) AS cut FROM placed),
train AS (SELECT series_key, ds, y, pos, cut AS n FROM cutoff WHERE pos < cut),
test AS (SELECT series_key, CAST(pos - cut + 1 AS INTEGER) AS step, ds, y FROM cutoff WHERE pos >= cut)"""
_WEIGHTS = """raw AS (SELECT series_key, model, 1 / (sqrt(avg(pow(y - yhat, 2))) + 1e-9) AS w
  FROM scored GROUP BY 1, 2),
weights AS (SELECT series_key, model, w / sum(w) OVER (PARTITION BY series_key) AS weight FROM raw)"""


def _validated() -> str:
    full = baselines_sql(NATION_WEEKLY)
    start = full.index("naive AS")
    return f"RECURSIVE {NATION_WEEKLY}, {_VALIDATION}, {full[start:]}"


@query("ensemble_weights", f"""WITH {_validated()}, {_WEIGHTS}
SELECT series_key, model, {rsql('weight', 6, 'weight')} FROM weights""")
def _(spark, folder):
    out = E.ensemble_weights(baselines(), nation_weekly(spark, folder))
    return out.withColumn("weight", rnd(F.col("weight")))


@query("ensemble_predict", f"""WITH {_validated()}, {_WEIGHTS}
SELECT series_key, step, ds, {rsql('greatest(sum(yhat * weight), CAST(0 AS DOUBLE))', 2, 'yhat')}
FROM scored JOIN weights USING (series_key, model) GROUP BY 1, 2, 3""")
def _(spark, folder):
    series = cut_lineage(nation_weekly(spark, folder))
    train, test = E.validation_split(series)
    forecast = run_models(baselines(), train, test.drop("y"))
    out = E.ensemble_predict(forecast, E.ensemble_weights(baselines(), series))
    return out.withColumn("yhat", rnd(F.col("yhat"), 2))


def _weights_within() -> str:
    """The ensemble's weights from the training rows alone, whose newest part is its validation."""
    full = baselines_sql(NATION_WEEKLY)
    return f"""(WITH RECURSIVE {NATION_WEEKLY}, known AS (SELECT series_key, ds, y FROM
  (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS place,
    count(*) OVER (PARTITION BY series_key) AS total FROM series)
  WHERE place < floor(total * CAST(0.8 AS DOUBLE))),
{_VALIDATION.replace("FROM series)", "FROM known)")}, {full[full.index("naive AS"):]}, {_WEIGHTS} SELECT * FROM weights)"""


@query("weighted_ensemble", f"""WITH RECURSIVE {baselines_sql(NATION_WEEKLY)}
SELECT s.series_key, s.step, s.ds, {rsql('greatest(sum(yhat * weight), CAST(0 AS DOUBLE))', 2, 'yhat')}
FROM scored s JOIN {_weights_within()} w ON w.series_key = s.series_key AND w.model = s.model GROUP BY 1, 2, 3""")
def _(spark, folder):
    train, test = train_test(cut_lineage(nation_weekly(spark, folder)))
    out = E.WeightedEnsemble(baselines()).forecast(train, test.drop("y"))
    return out.withColumn("yhat", rnd(F.col("yhat"), 2))


@query("stacking")
def _(spark, folder):
    train, test = train_test(cut_lineage(nation_weekly(spark, folder)))
    return E.Stacking([*baselines(), AR(7)]).forecast(train, test.drop("y"))


# --- tuning and runs -----------------------------------------------------------------------------

@query("tune_random_search")
def _(spark, folder):
    model = full_registry(freq="W")["elasticnet"]
    return tune_random_search(model, cut_lineage(nation_weekly(spark, folder)))[1]


@query("tune_random_forest")
def _(spark, folder):
    model = full_registry(freq="W")["random_forest"]
    return tune_random_search(model, cut_lineage(nation_weekly(spark, folder)))[1]


@query("adaptive_frequency", f"""WITH {METRICS}, best AS (SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) = 1)
SELECT series_key, {rsql('r2', 6, 'r2')}, r2 < 0.1 AS rerun, list_filter([
  CASE WHEN r2 < 0.1 THEN 'switch to weekly aggregation' END,
  CASE WHEN r2 < 0.7 THEN 'enable hyper-parameter tuning' END], lambda x: x IS NOT NULL) AS advice
FROM best""")
def _(spark, folder):
    best = R.best_model(backtest(baselines(), nation_weekly(spark, folder)))
    return adaptive_frequency(best, "D").withColumn("r2", rnd(F.col("r2")))


_BOTH_ROWS = """
rows_ AS (SELECT 'orders/' || n_name AS series_key, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'lines/' || p_brand, CAST(l_shipdate AS DATE),
    l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("run_all_datasets", f"""WITH RECURSIVE {baselines_sql(series_sql(_BOTH_ROWS, "W"))}, {metrics_sql()},
best AS (SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) = 1)
SELECT series_key, model, {rsql('rmse', 2, 'rmse')}, {rsql('r2', 6, 'r2')} FROM best""")
def _(spark, folder):
    sets = {"orders": nation_rows(spark, folder),
            "lines": read_sales_table(spark, folder, "lineitem", ("brand",))}
    models = {m.id: m for m in baselines()}
    out = run_all_datasets(sets, "W", periods=STEPS, combine=False, models=models).best
    return out.withColumn("rmse", rnd(F.col("rmse"), 2)).withColumn("r2", rnd(F.col("r2")))


def future_sql(panel: str, season: int, steps: int, step: str) -> str:
    """CTE ``scored`` with the baselines fitted on whole series, for the next ``steps`` periods."""
    full = baselines_sql(panel, season)
    return f"""{panel}, {PLACED}, train AS (SELECT series_key, ds, y, pos, n FROM placed),
test AS (SELECT series_key, CAST(h AS INTEGER) AS step, CAST(last_ds + h * {step} AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y
  FROM (SELECT series_key, max(ds) AS last_ds, unnest(range(1, {steps + 1})) AS h FROM placed GROUP BY 1)),
{full[full.index("naive AS"):]}"""


def best_sql(panel: str, season: int) -> str:
    return f"""(WITH RECURSIVE {baselines_sql(panel, season)}, {metrics_sql()} SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) = 1)"""


_FREQS = {"weekly": ("W", NATION_WEEKLY, 4), "monthly": ("MS", BRAND_MONTHLY, 12), "daily": ("D", EVENT_DAILY, 7)}
_EACH = " UNION ALL ".join(f"""SELECT '{name}' AS dataset, '{freq}' AS freq, 'ok' AS status,
  '{name}/' || series_key AS series_key, model, {rsql('rmse', 2, 'rmse')}, {rsql('r2', 6, 'r2')}
  FROM {best_sql(panel, season)}""" for name, (freq, panel, season) in _FREQS.items())


@query("run_datasets", f"""{_EACH}
UNION ALL SELECT 'days', 'D', 'too short', NULL, NULL, NULL, NULL
UNION ALL SELECT 'broken', 'W', 'failed', NULL, NULL, NULL, NULL""")
def _(spark, folder):
    """A weekly, a monthly and a daily dataset, one of few days and one without its columns, in one go."""
    events = read_sales_table(spark, folder, "events", ("event_type",))
    first = events.groupBy("series_key").agg(F.min("ds").alias("_first"))
    few = events.join(first, "series_key").where(F.col("ds") < F.date_add("_first", 5)).drop("_first")
    out = run_datasets({
        "weekly": (lambda: nation_rows(spark, folder), "W"),
        "monthly": (lambda: read_sales_table(spark, folder, "lineitem", ("brand",)), "MS"),
        "daily": (events, "D"), "days": (few, "D"),
        "broken": (lambda: nation_rows(spark, folder).select("no_such_column"), "W"),
    }, periods=STEPS, combine=False, models=lambda freq: {m.id: m for m in baselines(season_length(freq))})
    best = out.best.select("dataset", "series_key", "model", rnd(F.col("rmse"), 2).alias("rmse"), rnd(F.col("r2")).alias("r2"))
    return out.status.drop("reason").join(best, "dataset", "left")


class _LastChange:
    """A user's estimator: what the newest lag has been off by, on average."""

    def fit(self, x, y):
        self.shift = float(np.mean(y - x[:, 0])) if len(y) else 0.0

    def predict(self, x):
        return x[:, 0] + self.shift


class _BestColumn:
    """A user's meta-model: the base that was nearest on the out-of-fold rows."""

    def fit(self, x, y):
        self.column = int(np.abs(x - y[:, None]).mean(axis=0).argmin())

    def predict(self, x):
        return x[:, self.column]


@query("register_estimator")
def _(spark, folder):
    """A user's estimator, taken from the registry, and a user's meta-model, scored beside the baselines."""
    register_estimator("last_change", "Last change", _LastChange, log=False)
    try:
        model = full_registry(freq="W")["last_change"]
    finally:
        CUSTOM.pop("last_change")
    stack = E.Stacking([*baselines()], meta=_BestColumn)
    return backtest([*baselines(), model, stack], nation_weekly(spark, folder))


@query("future_forecast")
def _(spark, folder):
    models = {m.id: m for m in [Naive(), SeasonalNaive(SEASON), HoltWinters(season=SEASON), AR1()]}
    rows = read_sales_table(spark, folder, "orders", ("segment",))
    return run_rows(rows, "W", STEPS, models=models).forecast


@query("brand_monthly_scores", f"""WITH RECURSIVE {baselines_sql(BRAND_MONTHLY, 12)}, {metrics_sql()}
SELECT series_key, model, {rsql('rmse', 2, 'rmse')}, {rsql('r2', 6, 'r2')} FROM metrics""")
def _(spark, folder):
    out = forecast_metrics(score_holdout(baselines(12), brand_monthly(spark, folder)))
    return out.select("series_key", "model", rnd(F.col("rmse"), 2).alias("rmse"),
                      rnd(F.col("r2")).alias("r2"))


# --- answered requests ---------------------------------------------------------------------------

@query("request_answers", f"""WITH {_MESSAGES},
asked AS (SELECT subject, sender, mode, periods, dataset, count(*) AS messages FROM parsed GROUP BY ALL),
found AS (SELECT f.series_key || '_2024' AS dataset, f.model, f.step, f.yhat
  FROM (WITH RECURSIVE {future_sql(EVENT_DAILY, 7, 365, 'INTERVAL 1 DAY')} SELECT * FROM scored) f
  JOIN {best_sql(EVENT_DAILY, 7)} b ON b.series_key = f.series_key AND b.model = f.model)
SELECT subject, sender, mode, periods, a.dataset, messages,
  CASE WHEN count(model) > 0 THEN 'answered' ELSE 'unknown dataset' END AS status, any_value(model) AS model,
  count(model) AS steps, {rsql('sum(yhat)', 2, 'total')}
FROM asked a LEFT JOIN found f ON f.dataset = a.dataset AND f.step <= a.periods GROUP BY ALL""")
def _(spark, folder):
    """Messages streamed in, their datasets (the events of a kind) forecast, and the answers read back."""
    inbox, out = _fresh(spark, "inbox"), _fresh(spark, "answers")
    _messages(spark, folder).write.json(inbox)
    rows = read_sales_table(spark, folder, "events", ("event_type",)).select(
        F.concat("series_key", F.lit("_2024")).alias("dataset"), F.lit("all").alias("series_key"), "ds", "y")
    answer = forecast_answers(rows, "D", out, lambda mode: {m.id: m for m in baselines(7)}, combine=False)
    request_stream(spark, inbox, _fresh(spark, "marks"), answer).awaitTermination()
    key = ["subject", "sender", "mode", "periods", "dataset"]
    # A dataset has one series here, so a request has one model. As a key it leaves only numbers to add up, in a hash
    # table of a row per request; the largest of strings would sort every row of the forecasts first.
    totals = spark.read.parquet(f"{out}/forecast").groupBy(*key, "model").agg(
        F.count(F.lit(1)).alias("steps"), F.sum("yhat").alias("total"))
    status = spark.read.parquet(f"{out}/status").drop("batch")
    return status.join(totals, key, "left").select(
        *key, "messages", "status", "model", F.coalesce("steps", F.lit(0)).alias("steps"), rnd(F.col("total"), 2).alias("total"))
