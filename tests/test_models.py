import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.models import gram as G
from panelcast.models import perseries as P
from panelcast.models import pooled as R
from panelcast.models.autoregressive import AR, AR1, ar_coefficients
from panelcast.models.base import CustomForecaster, fit_status, run_models
from panelcast.models.baseline import Naive, SeasonalNaive
from panelcast.models.registry import QUICK, full_registry, panel_lags, quick_registry
from panelcast.models.smoothing import HoltWinters
from panelcast.models.wrappers import Differenced
from panelcast.operators.features import feature_names
from panelcast.operators.outlook import future_index
from panelcast.operators.series import train_test
from panelcast.plans.backtest import backtest
from panelcast.plans.ensemble import Stacking, WeightedEnsemble
from panelcast.sources.model_store import load_forecaster, load_model, save_forecaster, save_model

H = 12


@pytest.fixture(scope="module")
def panel(make):
    rng = np.random.default_rng(5)
    t = np.arange(150)
    season = 1 + 0.3 * np.sin(2 * np.pi * t / 7)
    series = {
        k: ("2023-01-02", "D", (base + slope * t) * season * rng.normal(1, 0.03, 150))
        for k, base, slope in (("a", 100, 0.2), ("b", 1000, -1.0), ("c", 40, 0.0))
    }
    return make(series), {k: np.asarray(v[2], dtype=float) for k, v in series.items()}


@pytest.fixture(scope="module")
def rows(panel):
    """Training rows of a regressor."""
    frame = R.training_frame(panel[0], 14, 150, True).cache()
    return frame, feature_names(14, 150)


def forecast(model, series, steps=H):
    out = model.forecast(series, future_index(series, steps, "D")).toPandas()
    return {k: g.sort_values("step")["yhat"].to_numpy() for k, g in out.groupby("series_key")}


def test_baselines(panel):
    df, y = panel
    naive, seasonal = forecast(Naive(), df), forecast(SeasonalNaive(7), df)
    for k in y:
        np.testing.assert_allclose(naive[k], np.full(H, y[k][-7:].mean()))
        np.testing.assert_allclose(seasonal[k], np.tile(y[k][-7:], 2)[:H])


def test_seasonal_naive_longer_than_history(make):
    df = make({"a": ("2024-01-01", "D", [1.0, -2.0, 3.0])})
    history, want = [1.0, -2.0, 3.0], []
    for _ in range(9):
        at = len(history) - 5
        history.append(max(history[at] if at >= 0 else history[-1], 0.0))
        want.append(history[-1])
    assert forecast(SeasonalNaive(5), df, 9)["a"].tolist() == want


def holt_winters(y, a, b, g, m, steps):
    if len(y) < 2 * m:
        m = max(2, len(y) // 4)
    level = y[:m].mean()
    trend = (y[m:2 * m].mean() - level) / m if len(y) >= 2 * m else 0.0
    season = list(y[:m] - level)
    for t, v in enumerate(y):
        s = season[t % m]
        new = a * (v - s) + (1 - a) * (level + trend)
        season[t % m] = g * (v - level) + (1 - g) * s
        trend = b * (new - level) + (1 - b) * trend
        level = new
    n = len(y)
    return [max(level + h * trend + season[(n + h - 1) % m], 0) for h in range(1, steps + 1)]


def test_holt_winters_equals_loop(panel, make):
    df, y = panel
    got = forecast(HoltWinters(season=7), df)
    for k in y:
        np.testing.assert_allclose(got[k], holt_winters(y[k], 0.3, 0.1, 0.1, 7, H), rtol=1e-12)
    short = np.arange(11, dtype=float)
    got = forecast(HoltWinters(season=7), make({"s": ("2024-01-01", "D", short)}))
    np.testing.assert_allclose(got["s"], holt_winters(short, 0.3, 0.1, 0.1, 7, H), rtol=1e-12)


@pytest.mark.parametrize("p", [1, 7])
def test_autoregression_equals_loop(panel, p):
    df, y = panel
    got = forecast(AR(p), df)
    one = forecast(AR1(), df)
    for k in y:
        beta = ar_coefficients(y[k], p)
        x = np.array([[1, *y[k][i - p:i][::-1]] for i in range(p, 150)])
        np.testing.assert_allclose(beta, np.linalg.lstsq(x, y[k][p:], rcond=None)[0])
        history = list(y[k])
        for _ in range(H):
            history.append(max(beta[0] + beta[1:] @ np.array(history[-p:][::-1]), 0.0))
        np.testing.assert_allclose(got[k], history[-H:], rtol=1e-9)
        if p == 1:
            np.testing.assert_allclose(one[k], history[-H:], rtol=1e-6)


def test_too_short_series_fail_alone(make):
    df = make({"ok": ("2024-01-01", "D", range(60)), "short": ("2024-01-01", "D", range(5))})
    status = fit_status(run_models([AR(7), Naive()], df, future_index(df, 3, "D")))
    got = {(r.series_key, r.model): r.status for r in status.collect()}
    assert got == {("ok", "ar"): "ok", ("short", "ar"): "failed",
                   ("ok", "naive"): "ok", ("short", "naive"): "ok"}


def scaled(rows):
    frame, names = rows
    pdf = frame.toPandas()
    x, y = pdf[names].to_numpy(), pdf["y"].to_numpy()
    sd = x.std(axis=0)
    live = sd > 1e-9
    return (x[:, live] - x[:, live].mean(axis=0)) / sd[live], y - y.mean(), live, sd


def test_gram_ridge_and_lasso_agree_with_dense_solutions(rows):
    x, y, live, sd = scaled(rows)
    g = G.gram(*rows)
    want = np.linalg.solve(x.T @ x + 1.0 * np.eye(x.shape[1]), x.T @ y)
    np.testing.assert_allclose(G.ridge(g, 1.0)[live], want, atol=1e-6)
    w = G.elastic_net(g, 0.01, 1.0, sweeps=20000, tol=1e-9)[live]
    # Optimality of the lasso: the gradient equals the penalty where w is not 0, else it is smaller.
    grad = x.T @ (y - x @ w) / len(y)
    np.testing.assert_allclose(grad[w != 0], 0.01 * np.sign(w[w != 0]), atol=1e-6)
    assert np.all(np.abs(grad) <= 0.01 + 1e-6)


def test_spark_linear_models_have_the_stated_penalties(rows):
    x, y, live, sd = scaled(rows)
    frame, names = rows
    got = R.solve_ridge(frame, names, 1.0)[0].coefficients * sd
    want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ y)
    np.testing.assert_allclose(got[live], want, atol=1e-5)
    for alpha, ratio in ((0.01, 1.0), (0.01, 0.5)):
        solve = R.solve_lasso if ratio == 1 else R.solve_elasticnet
        w = (solve(frame, names, alpha)[0].coefficients * sd)[live]
        grad = x.T @ (y - x @ w) / len(y) - alpha * (1 - ratio) * w
        assert np.all(np.abs(grad) <= alpha * ratio + 2e-4)


def test_least_squares_residuals_are_orthogonal(rows):
    frame, names = rows
    predictor, _ = R.solve_linear(frame, names)
    pdf = frame.toPandas()
    miss = pdf["y"].to_numpy() - predictor(pdf[names].to_numpy())
    x, *_ = scaled(rows)
    assert np.abs(x.T @ miss).max() < 1e-3


def test_bayesian_ridge_is_the_evidence_fixed_point(rows):
    x, y, live, sd = scaled(rows)
    noise, weight = 1 / y.var(), 1.0
    for _ in range(300):
        inverse = np.linalg.inv(weight * np.eye(x.shape[1]) + noise * x.T @ x)
        w = noise * inverse @ x.T @ y
        used = x.shape[1] - weight * np.trace(inverse)
        weight = used / (w @ w)
        noise = (len(y) - used) / np.sum((y - x @ w) ** 2)
    got = (R.solve_bayesian_ridge(*rows)[0].coefficients * sd)[live]
    np.testing.assert_allclose(got, w, atol=2e-3)


def test_tube_regression_reaches_its_minimum(spark):
    """The objective is no larger than that of a plain descent on the same features."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    y = 20 * np.sin(x[:, 0]) + 10 * x[:, 1] + rng.normal(0, 1, 120)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    fitted, _ = R.solve_fourier(frame, ["a", "b"], components=40, c=10.0, epsilon=0.5, rounds=60, tol=1e-6)
    z = np.column_stack([fitted.features(x), np.ones(120)])

    def value(w):
        return 0.5 * w[:-1] @ w[:-1] + 10.0 * np.maximum(np.abs(y - z @ w) - 0.5, 0).sum()

    w = np.append(np.zeros(40), y.mean())
    best = value(w)
    for i in range(20000):
        rest = y - z @ w
        slope = np.append(w[:-1], 0) - 10.0 * z.T @ (np.sign(rest) * (np.abs(rest) > 0.5))
        w = w - 0.5 / (10 + i) * slope / max(np.linalg.norm(slope), 1e-9) * 10
        best = min(best, value(w))
    assert value(np.append(fitted.linear.coefficients, fitted.linear.intercept)) <= best * 1.02


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(0)
    x, y, q = rng.normal(size=(300, 4)), rng.normal(size=300), rng.normal(size=(270, 4))
    q[3] = x[10]
    got = P.fit_knn(x, y, 5)(q)
    z, zq = (x - x.mean(0)) / x.std(0), (q - x.mean(0)) / x.std(0)
    for i in range(len(q)):
        d = np.linalg.norm(z - zq[i], axis=1)
        near = np.argsort(d)[:5]
        want = y[10] if i == 3 else np.average(y[near], weights=1 / d[near])
        assert abs(got[i] - want) < 1e-9


def test_network_learns_a_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    assert np.abs(P.fit_mlp(x, y)(x) - y).mean() < 0.3


def test_regressors_beat_the_naive_forecast(make):
    rng = np.random.default_rng(6)
    t = np.arange(600)
    wave = 1 + 0.3 * np.sin(2 * np.pi * t / 7)
    df = make({k: ("2021-01-02", "D", b * wave * rng.normal(1, 0.03, 600))
               for k, b in (("a", 100), ("b", 900))})
    models = full_registry(lags=14, freq="D", trees=150)
    wanted = ("naive", "lasso", "elasticnet", "knn", "gbt")
    scores = backtest([models[k] for k in wanted], df)
    mean = dict(scores.groupBy("model").agg(F.avg("mape")).collect())
    assert all(mean[k] < mean["naive"] for k in wanted[1:]), mean


def test_pooled_forecast_has_all_steps_and_stays_positive(panel):
    df, y = panel
    for key in ("differenced", "knn", "svr_rff"):
        model = full_registry(trees=3)[key]
        out = forecast(model.with_options(rounds=3) if key == "svr_rff" else model, df)
        assert all(len(v) == H and np.isfinite(v).all() and (v >= 0).all() for v in out.values())
        assert set(out) == set(y)


def test_saved_model_forecasts_the_same(spark, panel, tmp_path):
    df, _ = panel
    for key in ("ridge", "gbt", "svr_rff"):
        model = full_registry(trees=3)[key]
        fitted = (model.with_options(rounds=3) if key == "svr_rff" else model).fit(df)
        save_model(spark, fitted, str(tmp_path / key))
        back = load_model(spark, str(tmp_path / key))
        future = future_index(df, 5, "D")
        a, b = (m.forecast(df, future).orderBy("series_key", "step").toPandas()
                for m in (fitted, back))
        pd.testing.assert_frame_equal(a, b)
    assert back.feature_importance(spark).count() == 0


def test_models_of_every_kind_forecast_the_same_from_their_store(make, tmp_path):
    rng = np.random.default_rng(8)
    df = make({k: ("2023-01-02", "D", base * (1 + 0.3 * np.sin(np.arange(90) / 4)) + rng.normal(0, 2, 90))
               for k, base in (("a", 100), ("b", 300))})
    registered = full_registry(lags=7, trees=3)
    assert all(hasattr(m, "state") for m in registered.values())
    models = [registered[k] for k in ("naive", "seasonal_naive", "ar", "holt_winters", "differenced", "knn", "mlp", "catboost_preset")]
    few = [AR1(), *models[:2]]
    future = future_index(df, 4, "D")
    for model in [*models, AR1(), WeightedEnsemble(few), Stacking(few, folds=2)]:
        save_forecaster(model, df, str(tmp_path), "set")
        got, want = (x.orderBy("series_key", "step").toPandas()["yhat"].to_numpy()
                     for x in (load_forecaster(model, str(tmp_path), "set").forecast(future), model.forecast(df, future)))
        assert len(got) == 8 and np.isfinite(got).all(), model.id
        np.testing.assert_allclose(got, want, rtol=1e-6, err_msg=model.id)


def test_registry(panel):
    full, quick = full_registry(), quick_registry()
    assert len(full) == 22 and tuple(quick) == QUICK
    assert 7 <= panel_lags(panel[0]) <= 30


def test_users_can_plug_in_functions_and_estimators(panel):
    class MeanEstimator:
        def fit(self, x, y):
            self.level = y.mean()

        def predict(self, x):
            return np.full(len(x), self.level)

    df, y = panel
    custom = CustomForecaster("last", "Last", lambda h, s: [h["y"].iloc[-1]] * len(s))
    assert forecast(custom, df)["a"][0] == pytest.approx(y["a"][-1])
    plugged = P.PerSeriesRegressor("mean", "Mean", P.fit_estimator(MeanEstimator), log=False,
                                   warmup="drop")
    np.testing.assert_allclose(forecast(plugged, df)["b"], np.full(H, y["b"][37:].mean()))
    kept = P.PerSeriesRegressor("mean", "Mean", P.fit_estimator(MeanEstimator), log=False)
    np.testing.assert_allclose(forecast(kept, df)["b"], np.full(H, y["b"].mean()))
    diff = Differenced(Naive(window=149))
    step = (y["c"][-1] - y["c"][0]) / 149
    np.testing.assert_allclose(forecast(diff, df)["c"][0], y["c"][-1] + step)


def test_failing_custom_model_gives_null_rows(panel):
    def broken(history, steps):
        raise RuntimeError("no")

    train, test = train_test(panel[0])
    out = CustomForecaster("bad", "Bad", broken).forecast(train, test.drop("y"))
    assert out.where(F.col("yhat").isNotNull()).count() == 0 and out.count() == 90


@pytest.mark.parametrize("model", ["linear", "ridge", "gbt"])
def test_forecast_scales_with_the_series(make, model):
    """No bound of the log scale: a series times 100 has a forecast times 100, also above e^18."""
    rng = np.random.default_rng(0)
    y = 9e5 + 200 * np.arange(200) + 3e4 * np.sin(np.arange(200) / 8) + rng.normal(0, 1e4, 200)
    paths = []
    for scale in (1, 100):
        df = make({"a": ("2020-01-05", "7D", y * scale)})
        forecaster = full_registry(freq="W", trees=10)[model]
        path = forecaster.forecast(df, future_index(df, 8, "W")).toPandas().sort_values("step")
        paths.append(path["yhat"].to_numpy() / scale)
    assert paths[1] == pytest.approx(paths[0], rel=0.01)


def test_a_series_does_not_depend_on_its_neighbours(make):
    rng = np.random.default_rng(1)
    short, long = rng.uniform(50, 100, 85), rng.uniform(50, 100, 400)
    alone = make({"a": ("2022-01-01", "D", short)})
    panel = make({"a": ("2022-01-01", "D", short), "b": ("2022-01-01", "D", long)})
    forecaster = full_registry(freq="D")["knn"]
    one, both = (forecaster.forecast(d, future_index(d, 20, "D")).where("series_key = 'a'").toPandas()
                 .sort_values("step")["yhat"].to_numpy() for d in (alone, panel))
    assert both == pytest.approx(one)


def test_an_estimator_that_raises_fails_on_its_series_alone(make):
    class Picky:
        def fit(self, x, y):
            if y.max() > 1000:
                raise TypeError("no large values")
            self.level = y.mean()

        def predict(self, x):
            return np.full(len(x), self.level)

    df = make({"a": ("2022-01-01", "D", np.arange(40.0)), "b": ("2022-01-01", "D", np.arange(40.0) * 100)})
    model = P.PerSeriesRegressor("picky", "Picky", P.fit_estimator(Picky), log=False)
    out = run_models([Naive(), model], df, future_index(df, 3, "D"))
    status = {(r["series_key"], r["model"]): r["status"] for r in fit_status(out).collect()}
    assert status == {("a", "naive"): "ok", ("b", "naive"): "ok", ("a", "picky"): "ok", ("b", "picky"): "failed"}


def test_a_raising_model_fails_alone(make):
    class Broken:
        id = name = "broken"

        def forecast(self, train, future):
            raise RuntimeError("no fit")

    df = make({"a": ("2022-01-01", "D", np.arange(40.0))})
    out = run_models([Naive(), Broken()], df, future_index(df, 3, "D"))
    status = {r["model"]: r["status"] for r in fit_status(out).collect()}
    assert status == {"naive": "ok", "broken": "failed"}
