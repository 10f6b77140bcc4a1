from datetime import date

import numpy as np
import pandas as pd
import pytest

from panelcast.functions import calendar as C
from panelcast.models.recursion import History
from panelcast.operators import demand as D
from panelcast.operators import features as X

FIRST = "2022-03-01"


def frame(make, n=420, seed=1):
    y = np.random.default_rng(seed).gamma(2.0, 50.0, n)
    return y, make({"a": (FIRST, "D", y)})


def test_history_features_equal_pandas(make):
    y, df = frame(make)
    got = X.feature_matrix(df, lags=14).toPandas().sort_values("ds").reset_index(drop=True)
    s = pd.Series(y)
    past = s.shift(1)
    for k in (1, 7, 14, 182, 365):
        np.testing.assert_allclose(got[f"lag_{k}"], s.shift(k).fillna(0))
    for k in X.ROLL_WINDOWS:
        roll = past.rolling(k)
        np.testing.assert_allclose(got[f"roll_mean_{k}"], roll.mean().fillna(0), rtol=1e-10)
        np.testing.assert_allclose(got[f"roll_std_{k}"], roll.std().fillna(0), rtol=1e-9)
        np.testing.assert_allclose(got[f"roll_max_{k}"], roll.max().fillna(0))
        np.testing.assert_allclose(got[f"roll_min_{k}"], roll.min().fillna(0))
    for span in X.EWM_SPANS:
        want = past.ewm(span=span).mean().fillna(0)
        np.testing.assert_allclose(got[f"ewm_mean_{span}"], want, rtol=1e-12)


def test_exponential_means_cross_blocks(make):
    y, df = frame(make, n=1300)
    got = X.with_ewm(df).toPandas().sort_values("ds")
    for span in X.EWM_SPANS:
        want = pd.Series(y).shift(1).ewm(span=span).mean().fillna(0)
        np.testing.assert_allclose(got[f"ewm_mean_{span}"], want, rtol=1e-11)


def test_constant_windows_have_no_deviation(make):
    df = make({"a": (FIRST, "D", [0.0] * 70 + [5.0] * 40)})
    got = X.feature_matrix(df).toPandas()
    assert got.loc[got.ds == date(2022, 5, 10), "roll_std_60"].item() == 0
    assert got["roll_cv_30"].abs().max() < 10


def test_composite_windows():
    plan = X.window_plan(X.ROLL_WINDOWS)
    assert plan == {3: None, 7: None, 14: (7, 7), 30: None, 60: (30, 30), 90: (60, 30)}


def test_features_use_only_the_past(make):
    y, df = frame(make, n=120)
    changed = y.copy()
    changed[80:] *= 3
    names = X.history_names(14, 120)
    a = X.feature_matrix(df, longest=120).toPandas().sort_values("ds")[names]
    b = X.feature_matrix(make({"a": (FIRST, "D", changed)}), longest=120).toPandas().sort_values(
        "ds")[names]
    np.testing.assert_array_equal(a[:81].to_numpy(), b[:81].to_numpy())


def test_next_row_features_match_the_matrix(make):
    """The step-by-step driver forms the very features the training rows have."""
    y, df = frame(make, n=400)
    names = X.history_names(14, 400)
    want = X.feature_matrix(df, longest=400).toPandas().sort_values("ds")[names].to_numpy()
    for start in (2, 9, 60, 380):
        history = History([y[:start]], 20)
        for step in range(10):
            np.testing.assert_allclose(
                history.features(14, 400)[0], want[start + step], rtol=1e-9, atol=1e-9)
            history.append(y[[start + step]])


def test_last_row_equals_full_matrix(make):
    y, df = frame(make, n=400)
    last = X.last_feature_row(df).toPandas().iloc[0]
    full = X.feature_matrix(df).toPandas().sort_values("ds").iloc[-1]
    for name in X.feature_names(14, 367):
        # The tail carries the exponential means up to their truncation.
        assert abs(last[name] - full[name]) <= 1e-6 * max(1.0, abs(full[name])), name


def test_warm_up_rows_can_be_dropped(make):
    _, df = frame(make, n=50)
    assert X.feature_matrix(df, warmup="drop").count() == 36


def brute_festival(day):
    gaps = [abs((day - date(day.year, m, d)).days) for m, d in C.FESTIVALS]
    return max((15 - g) / 15 if g <= 14 else 0 for g in gaps)


def test_festival_lookup_and_join(make):
    df = make({"a": ("2023-12-01", "D", [1.0] * 800)})
    direct = X.feature_matrix(df, longest=800).select("ds", "festival_score").toPandas()
    assert np.allclose(direct["festival_score"], direct["ds"].map(brute_festival))
    joined = dict(X.festival_join(df).select("ds", "festival_score").collect())
    assert all(abs(joined[d] - brute_festival(d)) < 1e-12 for d in direct["ds"])


def test_profiles_give_positive_demand(spark, make):
    df = make({"a": ("2022-01-01", "D", [1.0] * 400)})
    for name, *_ in D.PROFILES:
        low = D.deseasonalise(df, name).agg({"expected": "min"}).first()[0]
        assert low > 0
    assert D.profile_table(spark).count() == 10


@pytest.mark.parametrize("span", [1, 2, 30, 365])
def test_ewm_of_any_span(make, span):
    y = np.random.default_rng(2).uniform(0, 10, 1500)
    got = X.with_ewm(make({"a": (FIRST, "D", y)}), (span,)).toPandas().sort_values("ds")[f"ewm_mean_{span}"]
    want = pd.Series(y).ewm(span=span, adjust=True).mean().shift(1).fillna(0.0)
    assert got.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9)


def test_too_many_lags_are_refused(make):
    with pytest.raises(ValueError):
        X.feature_matrix(make({"a": (FIRST, "D", np.arange(50.0))}), lags=31)
