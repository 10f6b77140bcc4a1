from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import series as S
from panelcast.spec import REGISTRY, SeriesSpec, validate


def test_gaps_are_filled_without_touching_known_rows(spark, values):
    rows = spark.createDataFrame(
        [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 4), 2.0), ("b", date(2024, 1, 2), 3.0)],
        "series_key string, ds date, y double",
    )
    assert values(S.fill_gaps(rows, "D")) == {"a": [1.0, 0.0, 0.0, 2.0], "b": [3.0]}
    joined = S.spine_left_join(rows, "D").na.fill(0.0)
    assert values(joined) == values(S.fill_gaps(rows, "D"))


@pytest.mark.parametrize("freq,offset", [("W", "W"), ("MS", "MS"), ("QS", "QS"), ("YS", "YS")])
def test_resample_labels_match_pandas(spark, freq, offset):
    days = pd.date_range("2021-12-20", "2023-02-10", freq="5D")
    y = np.arange(len(days), dtype=float)
    rows = spark.createDataFrame(
        [("a", d.date(), float(v)) for d, v in zip(days, y)], "series_key string, ds date, y double")
    got = S.fill_gaps(S.resample_sum(rows, freq), freq).toPandas().set_index("ds")["y"].sort_index()
    want = pd.Series(y, index=days).groupby(pd.Grouper(freq=offset)).sum()
    assert list(got.index) == [d.date() for d in want.index]
    assert got.tolist() == want.tolist()


def test_leading_zeros_and_all_zero_series(make, values):
    df = make({"a": ("2024-01-01", "D", [0, 0, 5, 0, 1]), "z": ("2024-01-01", "D", [0, 0, 0])})
    assert values(S.trim_leading_zeros(df)) == {"a": [5, 0, 1], "z": [0, 0, 0]}


def test_winsorize_equals_numpy_and_spares_constant_series(make, values):
    rng = np.random.default_rng(0)
    y = rng.gamma(2.0, 100.0, 200)
    df = make({"a": ("2024-01-01", "D", y), "c": ("2024-01-01", "D", [4.0] * 30)})
    got = values(S.winsorize(df))
    lo, hi = np.quantile(y, [0.005, 0.995])
    np.testing.assert_allclose(got["a"], np.clip(y, lo, hi), rtol=1e-12)
    assert got["c"] == [4.0] * 30
    lo, hi = np.quantile(y[:160], [0.005, 0.995])
    np.testing.assert_allclose(values(S.winsorize(df, fit_on="train"))["a"], np.clip(y, lo, hi))


def test_split_sizes_and_steps(make):
    df = make({"a": ("2024-01-01", "D", range(24)), "b": ("2024-01-01", "D", range(10))})
    train, test = S.train_test(df)
    sizes = dict(train.groupBy("series_key").count().collect())
    assert sizes == {"a": 19, "b": 8}
    assert [r.step for r in test.where("series_key = 'b'").orderBy("ds").collect()] == [1, 2]


def test_difference_and_integration_are_inverse(make, values):
    y = [3.0, 5.0, 2.0, 8.0]
    df = make({"a": ("2024-01-01", "D", y)})
    changes = S.first_difference(df).withColumn("step", F.dayofmonth("ds") - 1).withColumnRenamed(
        "y", "yhat")
    last = df.where("ds = '2024-01-01'").select("series_key", F.col("y").alias("last_y"))
    assert values(S.integrate_forecast(changes, last), "yhat")["a"] == y[1:]


def test_integration_clamps_output_but_not_level(make, values):
    changes = make({"a": ("2024-01-01", "D", [-5, 3, 4])}).withColumn(
        "step", F.dayofmonth("ds")).withColumnRenamed("y", "yhat")
    last = changes.sparkSession.createDataFrame([("a", 1.0)], "series_key string, last_y double")
    assert values(S.integrate_forecast(changes, last), "yhat")["a"] == [0.0, 0.0, 3.0]


def test_log_is_used_only_for_long_non_negative_series(make):
    df = make({"a": ("2024-01-01", "D", range(10)), "n": ("2024-01-01", "D", [-1] + [1] * 9),
               "s": ("2024-01-01", "D", range(9))})
    flags = dict(S.log1p_transform(df).groupBy("series_key").agg(F.first("use_log")).collect())
    assert flags == {"a": True, "n": False, "s": False}


def test_inverse_is_finite_and_bounded_only_when_asked(spark):
    df = spark.createDataFrame([(float("inf"), True), (50.0, True), (-3.0, False), (None, False)],
                               "p double, use_log boolean")

    def inverse(**limits):
        value = S.expm1_inverse(F.col("p"), F.col("use_log"), **limits)
        return [r[0] for r in df.select(value).collect()]

    got = inverse()
    assert np.isfinite(got[0]) and got[1:] == [pytest.approx(np.expm1(50.0)), 0.0, 0.0]
    assert inverse(log_bounds=(-12.0, 18.0)) == [np.expm1(18.0), np.expm1(18.0), 0.0, 0.0]


def test_cleaning_drops_what_does_not_parse(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "1.5"), ("01/31/2024", "2"), ("nonsense", "3"), ("2024-01-02", "x")],
        "day string, amount string")
    rows = S.clean_sales(df, SeriesSpec("day", "amount")).collect()
    assert sorted((r.ds, r.y) for r in rows) == [(date(2024, 1, 1), 1.5), (date(2024, 1, 31), 2.0)]
    with pytest.raises(ValueError, match="no valid rows"):
        S.require_rows(S.clean_sales(df.where("day = 'nonsense'"), SeriesSpec("day", "amount")))


def test_specifications():
    assert len(REGISTRY) == 10 and REGISTRY["toys_games"].freq == "W"
    assert SeriesSpec.from_mapping(
        {"date_col": "d", "target": "t", "description": ""}).freq == "D"
    with pytest.raises(ValueError, match="target"):
        SeriesSpec.from_mapping({"date_col": "d", "description": ""})


def test_validation_names_missing_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['d', 't'\]"):
        validate(df, SeriesSpec("d", "t", required_cols=("d", "t", "d")))


def test_short_series_are_set_aside(make):
    df = make({"a": ("2024-01-01", "D", range(20)), "b": ("2024-01-01", "D", range(19))})
    usable, rejected = S.split_usable(df)
    assert usable.select("series_key").distinct().collect()[0][0] == "a"
    assert [tuple(r) for r in rejected.collect()] == [("b", 19)]


def test_other_series_and_row_order_change_nothing(make, values):
    y = [0, 3, 0, 9, 4, 4, 100, 2] * 4
    alone = make({"a": ("2024-01-01", "D", y)})
    both = make({"b": ("2023-05-01", "D", y[::-1] * 2), "a": ("2024-01-01", "D", y)}).orderBy(
        F.rand(3)).repartition(5)
    assert values(S.build_series(alone, "W"))["a"] == values(S.build_series(both, "W"))["a"]
