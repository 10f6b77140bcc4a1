import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.models.autoregressive import AR
from panelcast.models.baseline import Naive, SeasonalNaive
from panelcast.models.registry import full_registry
from panelcast.models.smoothing import HoltWinters
from panelcast.operators import diagnostics as G
from panelcast.operators import insight as I
from panelcast.operators import metrics as M
from panelcast.operators import outlook as O
from panelcast.operators import report as P
from panelcast.operators.series import train_test
from panelcast.plans import ensemble as E
from panelcast.plans import folds as L
from panelcast.models.base import run_models
from panelcast.plans.backtest import refit_on_full
from panelcast.plans.run import run_adaptive, run_datasets, run_rows
from panelcast.plans.tune import GRIDS, sample_grid, tune_random_search
from panelcast.streaming.answers import answer_requests

BASE = [Naive(), SeasonalNaive(7), HoltWinters()]


@pytest.fixture(scope="module")
def panel(make):
    rng = np.random.default_rng(9)
    t = np.arange(130)
    wave = 1 + 0.4 * np.sin(2 * np.pi * t / 7)
    return make({k: ("2023-01-01", "D", b * wave * rng.normal(1, 0.05, 130))
                 for k, b in (("a", 100), ("b", 300))})


def test_folds_expand_and_never_overlap(panel):
    folds = L.time_series_folds(panel, 5).toPandas()
    for (_, fold), g in folds.groupby(["series_key", "fold"]):
        train, test = g[g.part == "train"], g[g.part == "test"]
        assert len(train) == 130 - (5 - fold) * 21 and len(test) == 21
        assert train.ds.max() < test.ds.min()
        assert sorted(test.step) == list(range(1, 22))


def test_weights_sum_to_one(panel):
    total = E.ensemble_weights(BASE, panel).groupBy("series_key").agg(F.sum("weight"))
    assert all(abs(r[1] - 1) < 1e-12 for r in total.collect())


def test_failed_model_gets_no_weight(make):
    df = make({"a": ("2024-01-01", "D", range(30))})
    weights = dict(E.ensemble_weights([Naive(), AR(28)], df).select("model", "weight").collect())
    assert weights == {"naive": 1.0, "ar": 0.0}


def test_stacking_weights_equal_ridge(panel):
    oof = L.out_of_fold(BASE, panel)
    got = E.stacking_weights(oof, [m.id for m in BASE]).toPandas().set_index("series_key")
    wide = oof.toPandas().pivot_table(index=["series_key", "ds"], columns="model", values="yhat")
    actual = oof.toPandas().groupby(["series_key", "ds"])["y"].first()
    x, y = wide.loc["a"][[m.id for m in BASE]].to_numpy(), actual.loc["a"].to_numpy()
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(got.loc["a", "weights"], w, rtol=1e-6)
    assert got.loc["a", "intercept"] == pytest.approx(y.mean() - w @ x.mean(0))


def test_stacking_needs_three_models():
    with pytest.raises(ValueError):
        E.Stacking(BASE[:2])


def test_pooled_models_are_fitted_per_fold(panel):
    out = L.out_of_fold([full_registry()["ridge"]], panel, 2)
    assert out.count() == 2 * 2 * (130 // 3)


def test_walk_forward_equals_loop(make):
    y = np.random.default_rng(2).gamma(3.0, 10.0, 100)
    walk = L.walk_forward(Naive(), make({"a": ("2023-01-01", "D", y)})).toPandas().sort_values("ds")
    window, step = 25, (100 - 25) // 20
    origins = range(window, 100, step)
    want = [abs(y[i] - y[i - 7:i].mean()) / (y[i] + 1e-9) * 100 for i in origins]
    np.testing.assert_allclose(walk["ape"], want)


def test_tuning_scores_linear_grids_like_direct_fits(panel):
    model = full_registry()["ridge"]
    best, table = tune_random_search(model, panel)
    scores = dict(table.select("params", "mae").collect())
    assert len(scores) == 5
    chosen = f'{{"alpha": {best.options["alpha"]}}}'
    assert scores[chosen] == min(scores.values())


def test_tuning_trees_and_models_without_grid(panel):
    model = full_registry()["gbt"]
    assert tune_random_search(model, panel)[0] is model
    points = [{"trees": 2, "depth": 2}, {"trees": 4, "depth": 3}]
    best, table = tune_random_search(full_registry()["random_forest"], panel, points)
    assert table.count() == 2 and best.options["trees"] in (2, 4)


def test_grid_samples_are_distinct_and_repeatable():
    points = sample_grid(GRIDS["xgb_preset"])
    assert len(points) == 20 == len({tuple(p.values()) for p in points})
    assert points == sample_grid(GRIDS["xgb_preset"])


def test_run_produces_one_forecast_per_series(panel):
    models = {m.id: m for m in BASE}
    result = run_rows(panel, "D", 10, models=models)
    assert result.forecast.groupBy("series_key").count().collect()[0]["count"] == 10
    assert {r.model for r in result.metrics.select("model").distinct().collect()} == {
        "naive", "seasonal_naive", "holt_winters", "weighted_ensemble", "stacking"}
    advice = result.recommendations(F.lit("2023-01-01").cast("date"))
    assert advice.groupBy("series_key").count().agg(F.min("count")).first()[0] == 6


def test_noise_is_rerun_by_week(make):
    y = np.random.default_rng(0).gamma(1.0, 10.0, 200)
    runs = run_adaptive(make({"a": ("2022-01-02", "D", y)}), "D", 5,
                        models={"naive": Naive()}, combine=False)
    assert [r.freq for r in runs] == ["D", "W"]


def test_metrics_of_constant_and_zero_actuals(spark):
    rows = [("c", "m", 5.0, 5.0), ("c", "m", 5.0, 5.0005), ("w", "m", 5.0, 9.0), ("w", "m", 5.0, 5.0),
            ("z", "m", 0.0, 0.0), ("z", "m", 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "series_key string, model string, y double, yhat double")
    got = {r.series_key: r for r in M.forecast_metrics(df).collect()}
    assert (got["c"].r2, got["w"].r2) == (1.0, 0.0)
    assert got["z"].mape is None and got["z"].smape == 0 and got["z"].mdape == 0


def test_partial_autocorrelation_of_an_autoregression(make):
    rng = np.random.default_rng(4)
    y = np.zeros(2000)
    for t in range(1, 2000):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    df = make({"a": ("2015-01-01", "D", y)})
    p = G.pacf(df).toPandas().sort_values("lag")["pacf"].to_numpy()
    assert p[0] == 1 and abs(p[1] - 0.7) < 0.05 and np.abs(p[2:]).max() < 0.1
    # Order k by solving the Yule-Walker equations directly.
    d = y - y.mean()
    r = np.array([d[k:] @ d[:len(d) - k] / (len(d) - k) for k in range(6)])
    table = r[np.abs(np.subtract.outer(np.arange(5), np.arange(5)))]
    assert p[5] == pytest.approx(np.linalg.solve(table, r[1:6])[-1], rel=1e-6)


def test_unit_root(make):
    rng = np.random.default_rng(8)
    steps = rng.normal(size=500)
    df = make({"walk": ("2020-01-01", "D", steps.cumsum()), "noise": ("2020-01-01", "D", steps),
               "flat": ("2020-01-01", "D", [3.0] * 50)})
    got = {r.series_key: r for r in G.adf_test(df).collect()}
    assert got["noise"].is_stationary and not got["walk"].is_stationary
    assert got["flat"].p_value == 1.0 and not got["flat"].is_stationary
    y = steps.cumsum()
    x = np.column_stack([y[:-1], np.ones(499)])
    beta, ssr, *_ = np.linalg.lstsq(x, np.diff(y), rcond=None)
    se = np.sqrt(ssr[0] / 497 * np.linalg.inv(x.T @ x)[0, 0])
    assert G.adf_statistic(y, 0)[0] == pytest.approx(beta[0] / se)
    assert G.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002)


def test_recommendation_levels(spark, make):
    history = make({k: ("2024-01-01", "D", [100.0] * 20) for k in ("up", "flat", "down")})
    future = spark.createDataFrame(
        [(k, i, v) for k, vs in (("up", (115, 120)), ("flat", (100, 101)), ("down", (20, 60)))
         for i, v in enumerate(map(float, vs), 1)], "series_key string, step int, yhat double"
    ).withColumn("ds", F.date_add(F.lit("2024-01-20").cast("date"), F.col("step")))
    got = I.insight_rules(history, future, F.lit("2024-01-21").cast("date")).collect()
    level = {(r.series_key, r.category): r.level for r in got}
    assert level["up", "Revenue"] == "high_growth" and level["down", "Revenue"] == "high_decline"
    assert level["flat", "Pricing"] == "stable" and level["down", "Operations"] == "high_vol"
    title = {(r.series_key, r.category): r.title for r in got}
    assert title["up", "Revenue"] == "Accelerate Growth (17.5% Projected)"
    assert title["flat", "Inventory"] == "Stock-up for Peak (22 Jan)"
    assert all(len(r.actions) == 3 and "{" not in r.description for r in got)


def test_rupees(spark):
    df = spark.createDataFrame([(2.5e7,), (1.5e5,), (1234.4,)], "v double")
    got = [r[0] for r in df.select(O.format_inr(F.col("v"))).collect()]
    assert got == ["₹2.50 Cr", "₹1.50 L", "₹1,234"]


def test_rupees_are_rounded_from_the_stored_number(spark):
    df = spark.createDataFrame([(1.005e7,), (1.125e5,), (1.375e5,)], "v double")
    got = [r[0] for r in df.select(O.format_inr(F.col("v"))).collect()]
    assert got == [f"₹{1.005e7 / 1e7:.2f} Cr", f"₹{1.125:.2f} L", f"₹{1.375:.2f} L"]


def test_report_rounds_scores_once(spark, make):
    """The list of models shows the error that the lines above it show, ties and near ties of two digits included."""
    errors = {"a": 3922678.9449696513, "b": 5762957.385, "c": 10753099.084958216, "d": 1.005, "e": 2.125, "f": 2.375}
    series = make({k: ("2024-01-01", "D", [1.0, 3.0]) for k in errors})
    metrics = spark.createDataFrame([(k, "naive", v, v, -0.00003) for k, v in errors.items()],
                                    "series_key string, model string, rmse double, mae double, r2 double")
    forecast = series.select("series_key", F.lit("naive").alias("model"), F.lit(1).alias("step"), "ds", F.col("y").alias("yhat"))
    for key, text in P.text_report(series, metrics, forecast).collect():
        lines = text.split("\n")
        assert f"RMSE             : {errors[key]:,.2f}" in lines
        assert lines[-1] == f"1. {'naive':<28} RMSE {errors[key]:>15,.2f}  R2 0.0000"


def test_hold_out_is_never_seen(panel):
    train, test = train_test(panel)
    assert train.join(test, ["series_key", "ds"]).isEmpty()


def test_registry_queries_score_every_member(spark, monkeypatch):
    from panelcast.models.registry import full_registry, quick_registry
    from panelcast.workload import QUERIES, plan_queries

    asked = []

    def backtest(models, series):
        asked.append({m.id for m in models})
        return spark.createDataFrame([], "series_key string, model string, rmse double")

    monkeypatch.setattr(plan_queries, "backtest", backtest)
    monkeypatch.setattr(plan_queries, "nation_weekly", lambda *_: None)
    for name, registry in (("model_registry_full", full_registry),
                           ("model_registry_quick", quick_registry)):
        QUERIES[name](spark, "").collect()
        assert asked.pop() == set(registry(freq="W"))


def test_pooled_models_share_their_feature_rows(make, monkeypatch):
    from panelcast.models import base, pooled
    from panelcast.models.registry import full_registry
    from panelcast.operators.outlook import future_index

    df = make({"a": ("2020-01-01", "D", [100.0 + i % 7 for i in range(120)])})
    built = []
    plain = pooled.training_frame
    monkeypatch.setattr(pooled, "training_frame", lambda *a: built.append(a) or plain(*a))
    registry = full_registry(freq="D")
    models = [registry[k] for k in ("linear", "bayesian_ridge")]
    future = future_index(df, 3, "D")
    together = base.run_models(models, df, future)
    assert len(built) == 1
    for m in models:
        alone = {r.step: r.yhat for r in m.forecast(df, future).collect()}
        shared = {r.step: r.yhat for r in together.where(f"model = '{m.id}'").collect()}
        assert len(alone) == 3 and all(abs(shared[s] - alone[s]) < 1e-6 for s in alone)


def test_model_queries_run_at_registered_size(spark, monkeypatch):
    from panelcast.models import pooled
    from panelcast.workload import QUERIES, plan_queries

    fits, searches = [], []
    monkeypatch.setattr(pooled.PooledRegressor, "fit", lambda self, _: fits.append(self) or 1 / 0)
    monkeypatch.setattr(plan_queries, "nation_weekly", lambda *_: None)
    monkeypatch.setattr(plan_queries, "cut_lineage", lambda df: df)
    monkeypatch.setattr(plan_queries, "train_test", lambda df: (df, type("Test", (), {"drop": lambda *_: None})()))
    monkeypatch.setattr(plan_queries, "tune_random_search",
                        lambda model, series, points=None: searches.append(points) or (model, None))
    registered = full_registry(freq="W")
    sized = ["random_forest", "extra_trees", "gbt", "hist_gbt", "xgb_preset", "lgbm_preset",
             "catboost_preset"]
    for name in [*(f"model_{k}" for k in sized), "feature_importance", "top_features"]:
        with pytest.raises(ZeroDivisionError):
            QUERIES[name](spark, "")
    assert [m.options for m in fits] == [registered[k].options for k in [*sized, *["random_forest"] * 2]]
    QUERIES["tune_random_forest"](spark, "")
    assert searches == [None]


class Failing:
    """Fails on one series, forecasts a constant on the others."""

    id = name = "failing"

    def __init__(self, bad, level=50.0):
        self.bad, self.level = bad, level

    def forecast(self, train, future):
        return future.withColumn("yhat", F.when(F.col("series_key") != self.bad, F.lit(self.level)).cast("double"))


def test_a_failed_winner_is_null_not_zero(panel, spark):
    winners = spark.createDataFrame([("a", "failing"), ("b", "failing")], "series_key string, model string")
    out = refit_on_full([Failing("a")], panel, winners, 3, "D").collect()
    assert {(r["series_key"], r["yhat"]) for r in out} == {("a", None), ("b", 50.0)}


def test_a_failed_member_does_not_lower_the_ensemble(panel, spark):
    future = O.future_index(panel, 2, "D")
    both = run_models([Naive(), Failing("a")], panel, future)
    weights = spark.createDataFrame([(k, m, 0.5) for k in "ab" for m in ("naive", "failing")],
                                    "series_key string, model string, weight double")
    plain = {r["series_key"]: r["yhat"] for r in both.where("model = 'naive'").collect()}
    got = {r["series_key"]: r["yhat"] for r in E.ensemble_predict(both, weights).collect()}
    assert got["a"] == pytest.approx(plain["a"]) and got["b"] == pytest.approx((plain["b"] + 50) / 2)
    none = E.ensemble_predict(both.withColumn("yhat", F.lit(None).cast("double")), weights)
    assert none.where("yhat IS NOT NULL").isEmpty()


def test_a_failed_base_of_stacking_counts_as_the_mean(panel):
    out = E.Stacking([*BASE, Failing("a")]).forecast(panel, O.future_index(panel, 7, "D")).collect()
    assert all(20 < r["yhat"] < 200 for r in out if r["series_key"] == "a")


def test_any_meta_model_stacks(panel):
    class First:
        def fit(self, x, y):
            self.width = x.shape[1]

        def predict(self, x):
            return x[:, 0] + self.width

    class Broken(First):
        def fit(self, x, y):
            raise KeyError("no")

    future = O.future_index(panel, 3, "D")
    naive = {(r["series_key"], r["step"]): r["yhat"] for r in Naive().forecast(panel, future).collect()}
    got = E.Stacking(BASE, meta=First).forecast(panel, future).collect()
    assert {(r["series_key"], r["step"]): r["yhat"] - 3 for r in got} == pytest.approx(naive)
    assert E.Stacking(BASE, meta=Broken).forecast(panel, future).where("yhat IS NOT NULL").isEmpty()


def test_calendar_folds_never_learn_from_tested_dates(make):
    df = make({"a": ("2023-01-01", "D", range(60)), "b": ("2023-01-21", "D", range(60)), "c": ("2023-03-01", "D", range(21))})
    folds = L.calendar_folds(df, 5).toPandas()
    size = 80 // 6
    for fold, g in folds.groupby("fold"):
        train, test = g[g.part == "train"], g[g.part == "test"]
        assert train.ds.max() < test.ds.min() and test.ds.nunique() == size
        for _, one in test.groupby("series_key"):
            assert sorted(one.step) == list(range(1, len(one) + 1))
    even = make({k: ("2023-01-01", "D", range(66)) for k in "xy"})
    same = [f(even, 5).select("series_key", "fold", "part", "ds").toPandas().sort_values(["series_key", "fold", "ds"]).to_numpy().tolist()
            for f in (L.calendar_folds, L.time_series_folds)]
    assert same[0] == same[1]


def test_requests_for_one_dataset_are_dealt_over_tasks(spark, make, monkeypatch):
    """Sorted joins, no partitions put together: a hot dataset must not meet all its requests in one task."""
    monkeypatch.setattr("panelcast.streaming.answers.TOGETHER", 5, raising=False)
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = make({"x": ("2023-01-01", "D", range(60))}).withColumn("dataset", F.lit("hot"))
    asked = spark.createDataFrame([(f"s{i}", f"u{i}", "quick", 1 + i % 3, "hot" if i % 4 else "gone") for i in range(80)] + [
        (None, None, "quick", 2, "hot")], "subject string, sender string, mode string, periods int, dataset string")
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        answers, status = answer_requests(asked, rows, "D", lambda mode: {"naive": Naive()}, combine=False)
        for frame in (answers, status.where("dataset = 'hot'")):
            sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)
        got = sorted(map(str, answers.select("subject", "sender", "periods", "step", "yhat").collect()))
        told = sorted(map(str, status.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    monkeypatch.setattr("panelcast.streaming.answers.TOGETHER", 10_000, raising=False)
    answers, status = answer_requests(asked, rows, "D", lambda mode: {"naive": Naive()}, combine=False)
    assert got == sorted(map(str, answers.select("subject", "sender", "periods", "step", "yhat").collect()))
    assert told == sorted(map(str, status.collect())) and len(told) == 81
    assert len(got) == sum(1 + i % 3 for i in range(80) if i % 4) + 2


def test_datasets_of_several_frequencies(spark, make):
    rng = np.random.default_rng(3)
    daily = make({"x": ("2023-01-01", "D", rng.uniform(50, 100, 60)), "y": ("2023-01-01", "D", rng.uniform(5, 9, 60))})
    monthly = make({"x": ("2015-01-01", "MS", rng.uniform(50, 100, 60))})

    def broken():
        raise OSError("no such file")

    out = run_datasets({"shop": (daily, "D"), "web": (lambda: monthly, "MS"), "new": (daily.limit(5), "D"),
                        "none": (daily.limit(0), "W"), "gone": (broken, "D"), "odd": (daily, "H")}, periods=4, combine=False,
                       models=lambda freq: {"naive": Naive(), "snaive": SeasonalNaive(7 if freq == "D" else 12)})
    status = {r["dataset"]: (r["freq"], r["status"]) for r in out.status.collect()}
    assert status == {"shop": ("D", "ok"), "web": ("MS", "ok"), "new": ("D", "too short"), "none": ("W", "too short"),
                      "gone": ("D", "failed"), "odd": ("H", "failed")}
    found = out.forecast.toPandas()
    assert set(found.series_key) == {"shop/x", "shop/y", "web/x"} and len(found) == 12
    months = sorted(found[found.dataset == "web"].ds.astype(str))
    assert months == ["2020-01-01", "2020-02-01", "2020-03-01", "2020-04-01"]


def test_requests_are_answered(spark, make):
    rng = np.random.default_rng(3)
    rows = make({"x": ("2023-01-01", "D", rng.uniform(50, 100, 60)), "y": ("2023-01-01", "D", rng.uniform(5, 9, 8))}).withColumn(
        "dataset", F.when(F.col("series_key") == "x", "shop").otherwise("new"))
    asked = spark.createDataFrame(
        [("s1", "u", "quick", 3, "shop"), ("s1", "u", "quick", 3, "shop"), ("s2", "u", "full", 5, "shop"),
         ("s3", "v", "quick", 2, "new"), ("s4", "v", "quick", 2, "what"), (None, None, "quick", 1, "shop")],
        "subject string, sender string, mode string, periods int, dataset string")
    answers, status = answer_requests(asked, rows, "D", lambda mode: {"naive": Naive(), "snaive": SeasonalNaive(7)}, combine=False)
    assert {(r["subject"], r["messages"], r["status"]) for r in status.collect()} == {
        ("s1", 2, "answered"), ("s2", 1, "answered"), ("s3", 1, "too short"), ("s4", 1, "unknown dataset"), (None, 1, "answered")}
    steps = answers.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count("yhat").alias("m")).collect()
    assert {(r["subject"], r["n"], r["m"]) for r in steps} == {("s1", 3, 3), ("s2", 5, 5), (None, 1, 1)}
    empty = answer_requests(asked.limit(0), rows, "D", combine=False)
    assert empty[0].isEmpty() and empty[1].isEmpty()


def test_metrics_of_levels_above_1e12(spark):
    rows = [("a", m, i, y, y * f) for m, f in (("good", 1.0), ("bad", 2.0))
            for i, y in enumerate((3e13, 5e13))]
    df = spark.createDataFrame(rows, "series_key string, model string, step int, y double, yhat double")
    got = {r.model: r for r in M.forecast_metrics(df).collect()}
    assert got["good"].rmse == 0.0 and got["good"].r2 == 1.0
    assert got["bad"].mae == 4e13
    assert {r.mae for r in M.forecast_metrics(df, bound=1e12).collect()} == {3.9e13}


def test_register_forecaster_query_goes_through_the_registry(spark, monkeypatch):
    from panelcast.models.base import CUSTOM
    from panelcast.workload import QUERIES, plan_queries

    seen = []

    def registry(**settings):
        seen.append(full_registry(**settings))
        return seen[-1]

    monkeypatch.setattr(plan_queries, "full_registry", registry)
    out = QUERIES["register_forecaster"](spark, "/root/testdata/sf0.001")
    assert out.where("yhat IS NULL").isEmpty() and not out.isEmpty()
    assert "drift" in seen[0] and "drift" not in CUSTOM
