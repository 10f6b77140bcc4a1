"""Queries over calendar and history features and the demand indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions import calendar as C
from panelcast.functions.numeric import rnd
from panelcast.operators import demand as D
from panelcast.operators import features as X
from panelcast.workload.base import (
    GLOBAL_DAILY,
    NATION_WEEKLY,
    global_daily,
    nation_weekly,
    query,
    rsql,
)

_INT_PARTS = ("year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear",
              "is_weekend", "is_month_start", "is_month_end", "is_quarter_start",
              "is_weekend_month", "is_payday", "dist_payday", "near_festival", "trend",
              "payday_weekend")

_WEEKEND = "(CASE WHEN isodow(ds) >= 6 THEN 1 ELSE 0 END)"
_DOW = "(isodow(ds) - 1)"
_PI2 = "(CAST(2 AS DOUBLE) * pi())"
_FEST = "greatest({}) / CAST(15 AS DOUBLE)".format(", ".join(
    ["CAST(0 AS DOUBLE)"]
    + [f"CAST(15 - abs(date_diff('day', make_date(year(ds), {m}, {d}), ds)) AS DOUBLE)"
       for m, d in C.FESTIVALS]
))
_TREND = "least(greatest(date_diff('day', DATE '2020-01-01', ds), -5000), 5000)"
_PAYDAY = "(CASE WHEN day(ds) IN (1, 2, 15, 16, 30, 31) THEN 1 ELSE 0 END)"

# Feature → SQL over ``ds``.
CAL_SQL = {
    "year": "year(ds)", "month": "month(ds)", "day": "day(ds)", "dayofweek": _DOW,
    "dayofyear": "dayofyear(ds)", "quarter": "quarter(ds)", "weekofyear": "weekofyear(ds)",
    "is_weekend": _WEEKEND,
    "is_month_start": "(CASE WHEN day(ds) = 1 THEN 1 ELSE 0 END)",
    "is_month_end": "(CASE WHEN last_day(ds) = ds THEN 1 ELSE 0 END)",
    "is_quarter_start": "(CASE WHEN date_trunc('quarter', ds) = ds THEN 1 ELSE 0 END)",
    "is_weekend_month": f"{_WEEKEND} * month(ds)",
    "is_payday": _PAYDAY,
    "dist_payday": "least(abs(day(ds) - 1), abs(day(ds) - 15), abs(day(ds) - 30))",
    "month_sin": f"sin({_PI2} * month(ds) / 12)", "month_cos": f"cos({_PI2} * month(ds) / 12)",
    "dow_sin": f"sin({_PI2} * {_DOW} / 7)", "dow_cos": f"cos({_PI2} * {_DOW} / 7)",
    **{f"{f}_{k}": f"{f}({_PI2} * {k} * dayofyear(ds) / CAST(365.25 AS DOUBLE))"
       for k in (1, 2, 3) for f in ("sin", "cos")},
    **{f"month_{f}_{k}": f"{f}({_PI2} * {k} * day(ds) / CAST(30.4375 AS DOUBLE))"
       for k in (1, 2) for f in ("sin", "cos")},
    **{f"dow_{f}_{k}": f"{f}({_PI2} * {k} * {_DOW} / 7)"
       for k in (1, 2, 3) for f in ("sin", "cos")},
    "festival_score": _FEST,
    "near_festival": f"(CASE WHEN {_FEST} > 0 THEN 1 ELSE 0 END)",
    "trend": _TREND,
    "trend_sq": f"pow({_TREND} / CAST(100 AS DOUBLE), 2)",
    "fest_trend": f"({_FEST}) * ({_TREND} / CAST(100 AS DOUBLE))",
    "fest_weekend": f"({_FEST}) * {_WEEKEND}",
    "payday_weekend": f"{_PAYDAY} * {_WEEKEND}",
    "trend_month": f"{_TREND} / CAST(100 AS DOUBLE) * sin({_PI2} * month(ds) / 12)",
    "trend_dow": f"{_TREND} / CAST(100 AS DOUBLE) * sin({_PI2} * {_DOW} / 7)",
}


def _cal_sql(names) -> str:
    parts = [f"CAST({CAL_SQL[n]} AS INTEGER) AS {n}" if n in _INT_PARTS
             else rsql(CAL_SQL[n], 6, n) for n in names]
    return f"WITH {GLOBAL_DAILY} SELECT series_key, ds, {', '.join(parts)} FROM series"


def _calendar_query(name: str, group) -> None:
    names = _GROUP_NAMES[name]

    def run(spark, folder):
        cols = group(F.col("ds"))
        out = [cols[n].cast("int").alias(n) if n in _INT_PARTS else rnd(cols[n]).alias(n)
               for n in names]
        return global_daily(spark, folder).select("series_key", "ds", *out)

    query(name, _cal_sql(names))(run)


_GROUP_NAMES = {
    "calendar_parts": ["year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear"],
    "calendar_flags": ["is_weekend", "is_month_start", "is_month_end", "is_quarter_start",
                       "is_weekend_month"],
    "payday_features": ["is_payday", "dist_payday"],
    "fourier_month_dow": ["month_sin", "month_cos", "dow_sin", "dow_cos"],
    "fourier_annual": ["sin_1", "cos_1", "sin_2", "cos_2", "sin_3", "cos_3"],
    "fourier_monthly": ["month_sin_1", "month_cos_1", "month_sin_2", "month_cos_2"],
    "fourier_weekly": ["dow_sin_1", "dow_cos_1", "dow_sin_2", "dow_cos_2", "dow_sin_3",
                       "dow_cos_3"],
    "festival_score": ["festival_score", "near_festival"],
    "trend_features": ["trend", "trend_sq"],
    "interaction_features": ["fest_trend", "fest_weekend", "payday_weekend", "trend_month",
                             "trend_dow"],
}
for _name, _group in (
    ("calendar_parts", C.calendar_parts), ("calendar_flags", C.calendar_flags),
    ("payday_features", C.payday_features), ("fourier_month_dow", C.fourier_month_dow),
    ("fourier_annual", C.fourier_annual), ("fourier_monthly", C.fourier_monthly),
    ("fourier_weekly", C.fourier_weekly), ("festival_score", C.festival_features),
    ("trend_features", C.trend_features), ("interaction_features", C.interaction_features),
):
    _calendar_query(_name, _group)


@query("festival_range_join", _cal_sql(["festival_score", "near_festival"]))
def _(spark, folder):
    out = X.festival_join(global_daily(spark, folder))
    return out.withColumn("festival_score", rnd(F.col("festival_score")))


# --- history features --------------------------------------------------------------------------

_W = "(PARTITION BY series_key ORDER BY ds)"
_ZERO = "CAST(0 AS DOUBLE)"


def _lag(k: int) -> str:
    return f"coalesce(lag(y, {k}) OVER {_W}, {_ZERO})"


def _lag_sql(lags: int) -> dict:
    return {f"lag_{k}": _lag(k) for k in range(1, lags + 1)}


_DIFF_SQL = {
    f"lag_diff_{name}": f"coalesce(lag(y, 1) OVER {_W} - lag(y, {k}) OVER {_W}, {_ZERO})"
    for name, k in ((1, 2), (7, 7))
}


def _roll_sql(windows) -> dict:
    out = {}
    for k in windows:
        over = (f"OVER (PARTITION BY series_key ORDER BY ds "
                f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)")
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")):
            out[f"roll_{name}_{k}"] = (
                f"CASE WHEN count(y) {over} = {k} THEN {fn}(y) {over} ELSE {_ZERO} END")
        cv = f"stddev_samp(y) {over} / nullif(avg(y) {over} + 1e-9, 0)"
        out[f"roll_cv_{k}"] = (
            f"CASE WHEN count(y) {over} = {k} THEN coalesce({cv}, {_ZERO}) ELSE {_ZERO} END")
    return out


def _ewm_sql(spans) -> dict:
    out = {}
    for span in spans:
        a = f"(CAST(2 AS DOUBLE) / {span + 1})"
        out[f"ewm_mean_{span}"] = (
            "CASE WHEN len(hist) > 0 THEN list_reduce(list_transform(hist, lambda v: "
            f"{{'n': v, 'd': CAST(1 AS DOUBLE)}}), lambda p, q: {{'n': p.n * (1 - {a}) + q.n, "
            f"'d': p.d * (1 - {a}) + CAST(1 AS DOUBLE)}})"
            f" ELSE {{'n': {_ZERO}, 'd': CAST(1 AS DOUBLE)}} END")
    return out


def _digits(name: str) -> int:
    # Means of up to 90 money values lie on a grid that has no rounding ties at seven digits.
    if name.startswith("roll_mean"):
        return 7
    if name.startswith(("roll_cv", "month_", "dow_", "sin_", "cos_", "festival", "fest_")):
        return 6
    return 4 if name.startswith(("lag_", "roll_max", "roll_min")) else 2


def _rounded(names) -> list:
    return [rnd(F.col(n), _digits(n)).alias(n) for n in names]


def _hist_sql(ctes: str, exprs: dict) -> str:
    cols = ", ".join(rsql(e, _digits(n), n) for n, e in exprs.items())
    return f"WITH {ctes} SELECT series_key, ds, {cols} FROM series"


def _hist_query(name: str, exprs: dict, make) -> None:
    def run(spark, folder):
        df = nation_weekly(spark, folder)
        return df.withColumns(make()).select("series_key", "ds", *_rounded(exprs))

    query(name, _hist_sql(NATION_WEEKLY, exprs))(run)


_hist_query("lag_features", _lag_sql(14), lambda: X.lag_features(14))
_hist_query("lag_diff", _DIFF_SQL, lambda: X.lag_diff(14))


@query("rolling_stats", _hist_sql(NATION_WEEKLY, _roll_sql(X.ROLL_WINDOWS)))
def _(spark, folder):
    df = X.with_rolling(nation_weekly(spark, folder))
    return df.select("series_key", "ds", *_rounded(_roll_sql(X.ROLL_WINDOWS)))


@query("seasonal_lags", _hist_sql(GLOBAL_DAILY, {f"lag_{k}": _lag(k) for k in (182, 365)}))
def _(spark, folder):
    df = global_daily(spark, folder)
    cols = X.seasonal_lags()
    return df.withColumns(cols).select("series_key", "ds", *_rounded(cols))


_EWM_CTE = """
h AS (SELECT series_key, ds, y, list(y) OVER (PARTITION BY series_key ORDER BY ds
    ROWS BETWEEN 600 PRECEDING AND 1 PRECEDING) AS hist FROM series),
e AS (SELECT series_key, ds, {}, {} FROM h)""".format(
    *[f"{e} AS s_{n}" for n, e in _ewm_sql((7, 30)).items()])


def _ewm_final(ctes: str) -> str:
    cols = ", ".join(rsql(f"s_ewm_mean_{s}.n / s_ewm_mean_{s}.d", 2, f"ewm_mean_{s}")
                     for s in (7, 30))
    return f"WITH {ctes}, {_EWM_CTE} SELECT series_key, ds, {cols} FROM e"


@query("ewm_mean", _ewm_final(NATION_WEEKLY))
def _(spark, folder):
    df = X.with_ewm(nation_weekly(spark, folder))
    return df.select("series_key", "ds", *_rounded(["ewm_mean_7", "ewm_mean_30"]))


@query("ewm_mean_daily", _ewm_final(GLOBAL_DAILY))
def _(spark, folder):
    df = X.with_ewm(global_daily(spark, folder))
    return df.select("series_key", "ds", *_rounded(["ewm_mean_7", "ewm_mean_30"]))


@query("feature_cleanup", f"""WITH {NATION_WEEKLY}, g AS (SELECT series_key, ds,
  CASE WHEN lag(y) OVER {_W} = 0 THEN 0 ELSE coalesce(y / lag(y) OVER {_W}, 0) END AS growth,
  CASE WHEN coalesce(lag(y) OVER {_W}, 0) = 0 THEN 0 ELSE
    least(y * 1e12 / lag(y) OVER {_W}, 1e15) END AS large FROM series)
SELECT series_key, ds, {rsql('growth', 6, 'growth')}, {rsql('large', 0, 'large')} FROM g""")
def _(spark, folder):
    before = F.lag("y").over(X.by_time())
    infinite = F.when(before == 0, F.lit(float("inf")))
    ratio = F.coalesce(infinite, F.try_divide(F.col("y"), before))
    big = F.coalesce(infinite, F.try_divide(F.col("y") * 1e12, before))
    df = nation_weekly(spark, folder).withColumn("growth", ratio).withColumn("large", big)
    out = X.feature_cleanup(df, ["growth", "large"])
    return out.select("series_key", "ds", rnd(F.col("growth"), 6).alias("growth"),
                      rnd(F.col("large"), 0).alias("large"))


_MATRIX_HIST = {**_lag_sql(14), **_DIFF_SQL, "lag_182": _lag(182), "lag_365": _lag(365),
                **_roll_sql(X.ROLL_WINDOWS)}


def matrix_sql(tail: str = "") -> str:
    """CTE ``matrix`` with every feature over the weekly panel, unrounded."""
    hist = ", ".join(f"{e} AS {n}" for n, e in _MATRIX_HIST.items())
    cal = ", ".join(f"CAST({CAL_SQL[n]} AS DOUBLE) AS {n}" for n in C.CALENDAR_NAMES)
    return f"""{NATION_WEEKLY}, {_EWM_CTE},
hist_ AS (SELECT series_key, ds, y, {hist} FROM series),
matrix AS (SELECT hist_.*, {cal},
  e.s_ewm_mean_7.n / e.s_ewm_mean_7.d AS ewm_mean_7,
  e.s_ewm_mean_30.n / e.s_ewm_mean_30.d AS ewm_mean_30
  FROM (SELECT * FROM hist_) hist_ JOIN (SELECT series_key AS k2, ds AS d2, s_ewm_mean_7,
    s_ewm_mean_30 FROM e) e ON k2 = series_key AND d2 = ds){tail}"""


_MATRIX_NAMES = [*C.CALENDAR_NAMES, *_MATRIX_HIST, "ewm_mean_7", "ewm_mean_30"]
_MATRIX_COLS = ", ".join(rsql(n, _digits(n), n) for n in _MATRIX_NAMES)


@query("feature_matrix", f"WITH {matrix_sql()} SELECT series_key, ds, {rsql('y', 4, 'y')}, "
                         f"{_MATRIX_COLS} FROM matrix")
def _(spark, folder):
    df = X.feature_matrix(nation_weekly(spark, folder), lags=14)
    names = [c for c in df.columns if c not in ("series_key", "ds", "y")]
    return df.select("series_key", "ds", rnd(F.col("y"), 4).alias("y"), *_rounded(names))


@query("last_feature_row", f"""WITH {matrix_sql()} SELECT series_key, ds, {rsql('y', 4, 'y')},
{_MATRIX_COLS} FROM matrix QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ds DESC) = 1""")
def _(spark, folder):
    df = X.last_feature_row(nation_weekly(spark, folder), lags=14)
    names = [c for c in df.columns if c not in ("series_key", "ds", "y")]
    return df.select("series_key", "ds", rnd(F.col("y"), 4).alias("y"), *_rounded(names))


# --- demand indices ----------------------------------------------------------------------------

_START = "(min(ds) OVER (PARTITION BY series_key))"
_GROWTH = "pow(CAST(1 AS DOUBLE) + {r}, date_diff('day', " + _START + ", ds) / CAST(365.25 AS DOUBLE))"
_WAVE = "{a} * sin(" + _PI2 + " * (dayofyear(ds) - {p}) / CAST(365.25 AS DOUBLE))"
_PULL = " + ".join(
    f"(CASE WHEN abs(date_diff('day', make_date(year(ds) + ({s}), {m}, {d}), ds)) <= 7 "
    f"THEN 1 - abs(date_diff('day', make_date(year(ds) + ({s}), {m}, {d}), ds)) / CAST(14 AS DOUBLE) "
    f"WHEN abs(date_diff('day', make_date(year(ds) + ({s}), {m}, {d}), ds)) <= 14 THEN "
    f"0.25 * (1 - (abs(date_diff('day', make_date(year(ds) + ({s}), {m}, {d}), ds)) - 7) "
    f"/ CAST(14 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END)"
    for s in (-1, 0, 1) for m, d in D.FESTIVALS)


def _index_query(name: str, column, sql: str) -> None:
    def run(spark, folder):
        df = global_daily(spark, folder).withColumn("_s", F.min("ds").over(X.by_key()))
        return df.select("series_key", "ds", rnd(column(), 6).alias("idx"))

    query(name, f"WITH {GLOBAL_DAILY} SELECT series_key, ds, {rsql(sql, 6, 'idx')} FROM series")(run)


_index_query("growth_index", lambda: D.growth_index(F.col("ds"), F.col("_s"), 0.15),
             _GROWTH.format(r="CAST(0.15 AS DOUBLE)"))
_index_query("annual_index", lambda: D.annual_index(F.col("ds"), 10, 0.30),
             "1 + " + _WAVE.format(a="CAST(0.3 AS DOUBLE)", p=285))
_index_query("weekend_index", lambda: D.weekend_index(F.col("ds"), 0.18),
             "1 + CAST(0.18 AS DOUBLE) * " + _WEEKEND)
_index_query("payday_index", lambda: D.payday_index(F.col("ds"), 0.12),
             "1 + CASE WHEN day(ds) <= 2 OR day(ds) >= 28 THEN CAST(0.12 AS DOUBLE) ELSE 0 END")
_index_query("festival_index", lambda: D.festival_index(F.col("ds"), 0.60, 1.0),
             f"1 + CAST(0.6 AS DOUBLE) * ({_PULL})")


def _demand_sql() -> str:
    f = {"r": "CAST(0.18 AS DOUBLE)"}
    expr = (f"CAST(350000 AS DOUBLE) * {_GROWTH.format(**f)} * (1 + "
            f"{_WAVE.format(a='CAST(0.4 AS DOUBLE)', p=285)}) * (1 + CAST(0.22 AS DOUBLE) * {_WEEKEND})"
            " * (1 + CASE WHEN day(ds) <= 2 OR day(ds) >= 28 THEN CAST(0.15 AS DOUBLE) ELSE 0 END)"
            f" * (1 + CAST(0.8 AS DOUBLE) * CAST(1.5 AS DOUBLE) * ({_PULL}))")
    return f"""WITH {GLOBAL_DAILY}, x AS (SELECT series_key, ds, y, {expr} AS expected FROM series)
SELECT series_key, ds, {rsql('expected', 2, 'expected')}, {rsql('y / expected', 6, 'ratio')} FROM x"""


@query("expected_demand", _demand_sql())
def _(spark, folder):
    df = D.deseasonalise(global_daily(spark, folder), "electronics_gadgets")
    return df.select("series_key", "ds", rnd(F.col("expected"), 2).alias("expected"),
                     rnd(F.col("ratio"), 6).alias("ratio"))


