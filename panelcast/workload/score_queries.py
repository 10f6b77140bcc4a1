"""Queries over metrics, leaderboards, outlooks and recommendations of the baselines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.models.base import fit_status, run_models
from panelcast.operators import insight as I
from panelcast.operators import joins as J
from panelcast.operators import metrics as M
from panelcast.operators import outlook as O
from panelcast.operators import ranking as R
from panelcast.operators import report as P
from panelcast.operators.series import train_test
from panelcast.plans.backtest import backtest, refit_on_full, score_holdout
from panelcast.session import cut_lineage, shared_folder
from panelcast.sources import files
from panelcast.workload.base import NATION_WEEKLY, PLACED, nation_weekly, query, rsql
from panelcast.workload.model_queries import SEASON, baselines, baselines_sql

# --- the scored hold-out in SQL ----------------------------------------------------------------

SCORED = f"RECURSIVE {baselines_sql(NATION_WEEKLY)}"
_P = "least(greatest(coalesce(yhat, 0), 0), CAST(1e300 AS DOUBLE))"


def metrics_sql(keys: str = "series_key, model") -> str:
    return f"""errs AS (SELECT *, {_P} AS p, abs(y - {_P}) AS e FROM scored),
metrics AS (SELECT {keys}, avg(e) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse,
  CASE WHEN stddev_pop(y) < 1e-9 THEN CASE WHEN bool_and(e <= 1e-3 + 1e-5 * abs(p)) THEN 1 ELSE 0 END
    ELSE 1 - avg(e * e) / var_pop(y) END AS r2,
  avg(CASE WHEN abs(y) > 1e-6 THEN e / abs(y) * 100 END) AS mape,
  coalesce(avg(CASE WHEN abs(y) + abs(p) > 1e-6 THEN 200 * e / (abs(y) + abs(p)) END), 0) AS smape,
  coalesce(median(CASE WHEN abs(y) > 1e-6 THEN e / abs(y) * 100 END), 0) AS mdape
  FROM errs GROUP BY {keys})"""


METRICS = f"{SCORED}, {metrics_sql()}"
_DIGITS = {"mae": 2, "mse": -2, "rmse": 2, "r2": 6, "mape": 4, "smape": 4, "mdape": 4}
_METRIC_COLS = ", ".join(rsql(c, d, c) for c, d in _DIGITS.items())


def scored_frame(spark, folder):
    return score_holdout(baselines(), nation_weekly(spark, folder))


def metrics_frame(spark, folder):
    return backtest(baselines(), nation_weekly(spark, folder))


def _round(df, digits: dict):
    return df.withColumns({c: rnd(F.col(c), d) for c, d in digits.items()})


@query("actual_vs_predicted", f"""WITH {SCORED} SELECT series_key, model, step, ds,
{rsql('y', 4, 'y')}, {rsql('yhat', 2, 'yhat')} FROM scored""")
def _(spark, folder):
    return _round(scored_frame(spark, folder), {"y": 4, "yhat": 2})


@query("forecast_metrics", f"WITH {METRICS} SELECT series_key, model, {_METRIC_COLS} FROM metrics")
def _(spark, folder):
    return _round(M.forecast_metrics(scored_frame(spark, folder)), _DIGITS)


@query("backtest", f"WITH {METRICS} SELECT series_key, model, {_METRIC_COLS} FROM metrics")
def _(spark, folder):
    return _round(metrics_frame(spark, folder), _DIGITS)


@query("fit_status", f"""WITH {SCORED} SELECT series_key, model,
CASE WHEN bool_or(yhat IS NULL) THEN 'failed' ELSE 'ok' END AS status FROM scored GROUP BY 1, 2""")
def _(spark, folder):
    train, test = train_test(nation_weekly(spark, folder))
    return fit_status(run_models(baselines(), train, test.drop("y")))


@query("oof_matrix", f"""WITH {SCORED} SELECT series_key, ds,
{", ".join(rsql(f"max(CASE WHEN model = '{m}' THEN yhat END)", 2, m)
           for m in ("naive", "seasonal_naive", "ar1", "holt_winters"))}
FROM scored GROUP BY 1, 2""")
def _(spark, folder):
    ids = [m.id for m in baselines()]
    wide = J.oof_matrix(scored_frame(spark, folder), ids)
    return _round(wide, {c: 2 for c in ids})


@query("residual_histogram", f"""WITH {SCORED}, r AS (SELECT series_key, model, y - yhat AS res
  FROM scored), lim AS (SELECT series_key, model, min(res) AS lo, max(res) AS hi FROM r GROUP BY 1, 2),
w AS (SELECT series_key, model, CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END AS lo,
  CASE WHEN hi > lo THEN hi ELSE hi + 0.5 END AS hi FROM lim),
b AS (SELECT r.series_key, r.model, least(CAST(floor((res - lo) / (hi - lo) * 30) AS INTEGER), 29)
  AS bin, count(*) AS c FROM r JOIN w USING (series_key, model) GROUP BY 1, 2, 3),
g AS (SELECT w.*, CAST(unnest(range(0, 30)) AS INTEGER) AS bin FROM w)
SELECT g.series_key, g.model, g.bin, {rsql('lo + (hi - lo) / 30 * g.bin', 2, '"left"')},
  coalesce(c, 0) AS count FROM g LEFT JOIN b ON b.series_key = g.series_key
  AND b.model = g.model AND b.bin = g.bin""")
def _(spark, folder):
    return _round(M.residual_histogram(scored_frame(spark, folder)), {"left": 2})


@query("quality_gate", f"""WITH {METRICS}, best AS (SELECT series_key,
  arg_min(r2, rmse) > 0.8 AS series_passed FROM metrics GROUP BY 1)
SELECT series_key, model, {rsql('r2', 6, 'r2')}, r2 > 0.8 AS passed, series_passed
FROM metrics JOIN best USING (series_key)""")
def _(spark, folder):
    return _round(M.quality_gate(metrics_frame(spark, folder)), {"r2": 6})


# --- leaderboards ------------------------------------------------------------------------------

_SCORES = {"rmse": 2, "r2": 6}
_SCORE_COLS = ", ".join(rsql(c, d, c) for c, d in _SCORES.items())


def _rank(order: str, over: str = "series_key") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {over} ORDER BY {order}) AS INTEGER)"


@query("leaderboard_rmse", f"""WITH {METRICS} SELECT series_key, model, {_SCORE_COLS},
{_rank('rmse, model')} AS rank FROM metrics""")
def _(spark, folder):
    out = R.leaderboard_rmse(metrics_frame(spark, folder))
    return _round(out.select("series_key", "model", "rmse", "r2", "rank"), _SCORES)


@query("leaderboard_r2", f"""WITH {METRICS} SELECT series_key, model, {_SCORE_COLS},
{_rank('r2 DESC, model')} AS rank FROM metrics""")
def _(spark, folder):
    out = R.leaderboard_r2(metrics_frame(spark, folder))
    return _round(out.select("series_key", "model", "rmse", "r2", "rank"), _SCORES)


@query("leaderboard_top_n", f"""WITH {METRICS}, k AS (SELECT *, {_rank('rmse, model')} AS rank
FROM metrics) SELECT series_key, rank, model, {rsql('rmse', 2, 'rmse')}, {rsql('mae', 2, 'mae')},
{rsql('r2', 4, 'r2')} FROM k WHERE rank <= 2""")
def _(spark, folder):
    out = R.leaderboard_top_n(metrics_frame(spark, folder), 2)
    return _round(out, {"rmse": 2, "mae": 2, "r2": 4})


@query("model_comparison", f"""WITH {METRICS}, u AS (
  SELECT series_key, model, 'rmse' AS metric, rmse AS value, rmse AS o FROM metrics
  UNION ALL SELECT series_key, model, 'mae', mae, mae FROM metrics
  UNION ALL SELECT series_key, model, 'r2', r2, -r2 FROM metrics)
SELECT series_key, model, metric, {rsql('value', 2, 'value')},
{_rank('o, model', 'series_key, metric')} AS rank FROM u""")
def _(spark, folder):
    return _round(R.model_comparison(metrics_frame(spark, folder)), {"value": 2})


_BEST = """best AS (SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) = 1)"""


@query("best_model", f"WITH {METRICS}, {_BEST} SELECT series_key, model, {_SCORE_COLS} FROM best")
def _(spark, folder):
    return _round(R.best_model(metrics_frame(spark, folder)), _SCORES)


@query("union_metrics", f"""WITH {METRICS} SELECT series_key, model, {_SCORE_COLS} FROM metrics
UNION ALL SELECT series_key, 'best', {rsql('min(rmse)', 2, 'rmse')},
{rsql('arg_min(r2, rmse)', 6, 'r2')} FROM metrics GROUP BY 1""")
def _(spark, folder):
    scores = metrics_frame(spark, folder).select("series_key", "model", "rmse", "r2")
    top = R.best_model(scores).withColumn("model", F.lit("best"))
    return _round(R.union_metrics(scores, top), _SCORES)


# --- outlook: the next 12 weeks by the seasonal naive forecaster ---------------------------------

STEPS = 12
_FUTURE = f"""last_ AS (SELECT series_key, max(ds) AS last, count(*) AS n FROM series GROUP BY 1),
pos_ AS (SELECT series_key, y, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS pos
  FROM series),
steps AS (SELECT series_key, last, n, CAST(unnest(range(1, {STEPS + 1})) AS INTEGER) AS step FROM last_),
forecast AS (SELECT s.series_key, s.step, last + 7 * s.step AS ds,
  greatest(p.y, CAST(0 AS DOUBLE)) AS yhat FROM steps s JOIN pos_ p ON p.series_key = s.series_key
  AND p.pos = s.n - {SEASON} + (s.step - 1) % {SEASON})"""
OUTLOOK = f"{NATION_WEEKLY}, {_FUTURE}"


def outlook(spark, folder):
    series = nation_weekly(spark, folder)
    future = O.future_index(series, STEPS, "W")
    return series, baselines()[1].forecast(series, future)


@query("future_index", f"WITH {OUTLOOK} SELECT series_key, step, ds FROM forecast")
def _(spark, folder):
    return O.future_index(nation_weekly(spark, folder), STEPS, "W")


def _future_other(freq):
    from panelcast.operators.series import build_series
    from panelcast.sources.tables import read_sales_table

    def run(spark, folder):
        rows = read_sales_table(spark, folder, "lineitem", ("brand",))
        return O.future_index(build_series(rows, freq), 8, freq)

    return run


for _freq, _unit, _months in (("MS", "month", 1), ("QS", "quarter", 3), ("YS", "year", 12)):
    query(f"future_index_{_freq.lower()}", f"""WITH m AS (SELECT p_brand AS series_key,
  date_trunc('{_unit}', max(l_shipdate)) AS last FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1), s AS (SELECT series_key, last, CAST(unnest(range(1, 9)) AS INTEGER) AS step FROM m)
SELECT series_key, step, CAST(last + to_months({_months} * step) AS DATE) AS ds FROM s""")(
        _future_other(_freq))


@query("forecast_band", f"""WITH {OUTLOOK} SELECT series_key, step, ds, {rsql('yhat', 4, 'yhat')},
{rsql('yhat * CAST(0.9 AS DOUBLE)', 4, 'lo')}, {rsql('yhat * CAST(1.1 AS DOUBLE)', 4, 'hi')}
FROM forecast""")
def _(spark, folder):
    return _round(O.forecast_band(outlook(spark, folder)[1]), {"yhat": 4, "lo": 4, "hi": 4})


@query("history_forecast_outer", f"""WITH {OUTLOOK} SELECT series_key, ds, {rsql('y', 4, 'y')},
{rsql('yhat', 4, 'yhat')} FROM series FULL JOIN forecast USING (series_key, ds)""")
def _(spark, folder):
    return _round(O.history_forecast_outer(*outlook(spark, folder)), {"y": 4, "yhat": 4})


@query("forecast_overlay", f"""WITH {SCORED}, {_FUTURE},
parts AS (SELECT series_key, ds, 'train' AS segment, y AS value FROM train
  UNION ALL SELECT series_key, ds, 'test', y FROM test
  UNION ALL SELECT series_key, ds, 'predicted', yhat FROM snaive
  UNION ALL SELECT series_key, ds, 'future', yhat FROM forecast)
SELECT series_key, ds, segment, {rsql('value', 4, 'value')} FROM parts""")
def _(spark, folder):
    series, future = outlook(spark, folder)
    train, test = train_test(series)
    predicted = baselines()[1].forecast(train, test.drop("y"))
    return _round(O.forecast_overlay(train, test, predicted, future), {"value": 4})


@query("market_trend", f"""WITH {OUTLOOK}, t AS (SELECT * FROM
  (SELECT series_key, avg(y) AS avg_hist FROM series GROUP BY 1) JOIN
  (SELECT series_key, avg(yhat) AS avg_fut FROM forecast GROUP BY 1) USING (series_key)),
p AS (SELECT *, coalesce((avg_fut - avg_hist) / nullif(avg_hist, 0) * 100, 0) AS pct FROM t)
SELECT series_key, {rsql('avg_hist', 2, 'avg_hist')}, {rsql('avg_fut', 6, 'avg_fut')},
{rsql('pct', 6, 'pct')}, CASE WHEN pct >= 0 THEN 'higher' ELSE 'lower' END AS direction FROM p""")
def _(spark, folder):
    return _round(M.market_trend(*outlook(spark, folder)), {"avg_hist": 2, "avg_fut": 6, "pct": 6})


@query("forecast_summary", f"""WITH {OUTLOOK} SELECT series_key, min(ds) AS date_from,
max(ds) AS date_to, {rsql('sum(yhat)', 4, 'total')}, {rsql('avg(yhat)', 6, 'mean')},
{rsql('max(yhat)', 4, 'peak')}, count(*) AS periods FROM forecast GROUP BY 1""")
def _(spark, folder):
    out = M.forecast_summary(outlook(spark, folder)[1])
    return _round(out, {"total": 4, "mean": 6, "peak": 4})


_PEAK = """peaks AS (SELECT series_key, max(yhat) AS peak, min(yhat) AS trough FROM forecast GROUP BY 1),
extremes AS (SELECT p.series_key, peak, trough, min(CASE WHEN yhat = peak THEN ds END) AS peak_ds,
  min(CASE WHEN yhat = trough THEN ds END) AS trough_ds
  FROM peaks p JOIN forecast f ON f.series_key = p.series_key GROUP BY 1, 2, 3)"""


@query("peak_trough", f"""WITH {OUTLOOK}, {_PEAK} SELECT series_key, peak_ds,
{rsql('peak', 4, 'peak')}, trough_ds, {rsql('trough', 4, 'trough')} FROM extremes""")
def _(spark, folder):
    return _round(M.peak_trough(outlook(spark, folder)[1]), {"peak": 4, "trough": 4})


_VOL = "CASE WHEN avg(yhat) > 0 THEN stddev_pop(yhat) / avg(yhat) ELSE 0 END"


@query("forecast_volatility", f"""WITH {OUTLOOK} SELECT series_key, {rsql(_VOL, 6, 'volatility')}
FROM forecast GROUP BY 1""")
def _(spark, folder):
    return _round(M.forecast_volatility(outlook(spark, folder)[1]), {"volatility": 6})


@query("cross_dataset_summary", f"""WITH {METRICS}, {_BEST}, f AS (SELECT series_key, model,
  avg(yhat) AS a FROM scored GROUP BY 1, 2)
SELECT series_key, model, {_SCORE_COLS}, {rsql('a', 2, 'avg_forecast')} FROM best
JOIN f USING (series_key, model)""")
def _(spark, folder):
    scored = scored_frame(spark, folder)
    out = M.cross_dataset_summary(M.forecast_metrics(scored), scored)
    return _round(out, {**_SCORES, "avg_forecast": 2})


@query("format_inr", f"""WITH {OUTLOOK}, s AS (SELECT series_key, sum(yhat) AS total,
  avg(yhat) AS mean FROM forecast GROUP BY 1)
SELECT series_key, {{0}} AS total, {{1}} AS mean FROM s""".replace("{0}", """CASE
  WHEN total >= 1e7 THEN '₹' || printf('%.2f', total / 1e7) || ' Cr'
  WHEN total >= 1e5 THEN '₹' || printf('%.2f', total / 1e5) || ' L'
  ELSE '₹' || format('{:,.0f}', total) END""").replace("{1}", """CASE
  WHEN mean >= 1e7 THEN '₹' || printf('%.2f', mean / 1e7) || ' Cr'
  WHEN mean >= 1e5 THEN '₹' || printf('%.2f', mean / 1e5) || ' L'
  ELSE '₹' || format('{:,.0f}', mean) END"""))
def _(spark, folder):
    out = M.forecast_summary(outlook(spark, folder)[1])
    return out.select("series_key", O.format_inr(F.col("total")).alias("total"),
                      O.format_inr(F.col("mean")).alias("mean"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TEXT_ROWS = ", ".join(
    f"({', '.join(map(_quote, t[:4]))}, [{', '.join(map(_quote, t[4]))}])" for t in I.TEXTS)


def _fill_sql(column: str) -> str:
    out = column
    for mark, value in (("pct", "printf('%.1f', pct)"), ("abs", "printf('%.1f', abs(pct))"),
                        ("vol", "printf('%.1f', volatility * 100)"),
                        ("peak", "format('{:,.0f}', peak)"), ("day", "strftime(peak_ds, '%d %b')")):
        out = f"replace({out}, '{{{mark}}}', {value})"
    return out


@query("insight_rules", f"""WITH {OUTLOOK}, {_PEAK},
v AS (SELECT series_key, {_VOL} AS volatility, avg(yhat) AS avg_fut FROM forecast GROUP BY 1),
h AS (SELECT series_key, avg(y) AS avg_hist FROM series GROUP BY 1),
facts AS (SELECT e.*, volatility, CASE WHEN avg_hist > 0 THEN (avg_fut - avg_hist) / avg_hist * 100
  ELSE 0 END AS pct FROM extremes e JOIN v USING (series_key) JOIN h USING (series_key)),
hits AS (SELECT *, 'Revenue' AS category, CASE WHEN pct > 10 THEN 'high_growth'
    WHEN pct > 5 THEN 'moderate_growth' WHEN pct < -10 THEN 'high_decline'
    WHEN pct < -5 THEN 'moderate_decline' ELSE 'stable' END AS level FROM facts
  UNION ALL SELECT *, 'Inventory', 'peak_ahead' FROM facts WHERE peak_ds > DATE '2001-08-26'
  UNION ALL SELECT *, 'Marketing', 'schedule' FROM facts
  UNION ALL SELECT *, 'Operations', CASE WHEN volatility > 0.2 THEN 'high_vol' ELSE 'low_vol' END
    FROM facts
  UNION ALL SELECT *, 'Pricing', CASE WHEN pct > 10 THEN 'high_demand' WHEN pct < -5
    THEN 'low_demand' ELSE 'stable' END FROM facts
  UNION ALL SELECT *, 'Risk', CASE WHEN volatility > 0.2 OR abs(pct) > 10 THEN 'high_risk'
    ELSE 'low_risk' END FROM facts),
texts(category, level, title, description, actions) AS (VALUES {_TEXT_ROWS})
SELECT series_key, category, level, {_fill_sql('title')} AS title,
{_fill_sql('description')} AS description, actions FROM hits JOIN texts USING (category, level)""")
def _(spark, folder):
    series, forecast = outlook(spark, folder)
    return I.insight_rules(series, forecast, F.lit("2001-08-26").cast("date"))


def _refit_ctes() -> str:
    """CTEs ``scored``, the forecasts of the next weeks, and ``best``, the winner of each series."""
    full = baselines_sql(NATION_WEEKLY)
    return f"""WITH RECURSIVE {NATION_WEEKLY}, {PLACED}, train AS (SELECT series_key, ds, y, pos, n FROM placed),
test AS (SELECT series_key, CAST(h AS INTEGER) AS step, CAST(last_ds + h * INTERVAL 7 DAY AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y
  FROM (SELECT series_key, max(ds) AS last_ds, unnest(range(1, {STEPS + 1})) AS h FROM placed GROUP BY 1)),
{full[full.index("naive AS"):]},
best AS (SELECT series_key, model FROM (WITH {METRICS} SELECT * FROM metrics
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) = 1))"""


@query("refit_on_full", f"""{_refit_ctes()}
SELECT series_key, model, step, ds, {rsql('yhat', 2, 'yhat')} FROM scored JOIN best USING (series_key, model)""")
def _(spark, folder):
    series = cut_lineage(nation_weekly(spark, folder))
    winners = R.best_model(backtest(baselines(), series)).select("series_key", "model")
    out = refit_on_full(baselines(), series, winners, STEPS, "W")
    return _round(out, {"yhat": 2})


def _report_parts(spark, folder):
    series = cut_lineage(nation_weekly(spark, folder))
    scores = cut_lineage(backtest(baselines(), series))
    future = O.future_index(series, STEPS, "W")
    return series, scores, cut_lineage(run_models(baselines(), series, future))


def _inr_sql(value: str) -> str:
    return f"""CASE WHEN {value} >= 1e7 THEN '₹' || printf('%.2f', {value} / 1e7) || ' Cr'
  WHEN {value} >= 1e5 THEN '₹' || printf('%.2f', {value} / 1e5) || ' L' ELSE '₹' || format('{{:,.2f}}', {value}) END"""


@query("text_report", f"""{_refit_ctes()},
scores AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY rmse, model) AS place
  FROM (WITH {METRICS} SELECT * FROM metrics)),
top AS (SELECT series_key, string_agg(place || '. ' || model || repeat(' ', greatest(28 - length(model), 0)) || ' RMSE '
  || repeat(' ', greatest(15 - length(amount), 0)) || amount || '  R2 ' || printf('%.4f', round(r2, 4) + 0), chr(10) ORDER BY place) AS lines
  FROM (SELECT *, format('{{:,.2f}}', round(rmse, 4)) AS amount FROM scores) WHERE place <= 5 GROUP BY 1),
ahead AS (SELECT series_key, min(ds) AS first, max(ds) AS last, sum(yhat) AS total, avg(yhat) AS mean, count(*) AS periods
  FROM scored JOIN best USING (series_key, model) GROUP BY 1),
trend AS (SELECT series_key, coalesce((any_value(mean) - avg(y)) / nullif(avg(y), 0) * 100, 0) AS pct
  FROM series JOIN ahead USING (series_key) GROUP BY 1)
SELECT series_key, array_to_string([
  'SALES FORECAST REPORT', 'Dataset          : ' || series_key, 'Best model       : ' || model, 'Mode             : QUICK',
  'FORECAST SUMMARY (' || periods || ' periods ahead)', 'From             : ' || first, 'To               : ' || last,
  'Total forecast   : ' || {_inr_sql("total")}, 'Mean per period  : ' || {_inr_sql("mean")},
  'Market trend     : ' || printf('%.1f', abs(pct)) || '% ' || CASE WHEN pct >= 0 THEN 'higher' ELSE 'lower' END
    || ' than historical average',
  'BEST MODEL PERFORMANCE', 'RMSE             : ' || format('{{:,.2f}}', rmse), 'MAE              : ' || format('{{:,.2f}}', mae),
  'R2               : ' || printf('%.4f', round(r2, 4) + 0), 'TOP 5 MODELS', lines], chr(10)) AS report
FROM scores JOIN top USING (series_key) JOIN ahead USING (series_key) JOIN trend USING (series_key) WHERE place = 1""")
def _(spark, folder):
    return P.text_report(*_report_parts(spark, folder))


@query("write_forecast_json", f"""{_refit_ctes()}
SELECT series_key, any_value(model) AS best_model, CAST(count(*) AS INTEGER) AS periods,
  CASE WHEN coalesce((avg(yhat) - any_value(past)) / nullif(any_value(past), 0), 0) >= 0
    THEN 'higher' ELSE 'lower' END AS direction
FROM scored JOIN best USING (series_key, model)
JOIN (SELECT series_key, avg(y) AS past FROM series GROUP BY 1) USING (series_key) GROUP BY 1""")
def _(spark, folder):
    series, scores, forecast = _report_parts(spark, folder)
    best = R.best_model(scores).select("series_key", "model")
    own = forecast.join(best, ["series_key", "model"])
    advice = I.insight_rules(series, own, F.lit("2001-08-26").cast("date"))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    files.write_json_lines(P.json_result(series, scores, forecast, advice), path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.dataset").alias("series_key"),
        F.get_json_object("value", "$.best_model").alias("best_model"),
        F.get_json_object("value", "$.forecast_periods").cast("int").alias("periods"),
        F.get_json_object("value", "$.market_trend_direction").alias("direction"),
    )


@query("write_metrics", f"WITH {METRICS} SELECT series_key, model, {_SCORE_COLS} FROM metrics")
def _(spark, folder):
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    scores = metrics_frame(spark, folder).withColumn("dataset", F.lit("nation_weekly"))
    files.write_metrics(scores, path)
    return _round(spark.read.parquet(path).select("series_key", "model", "rmse", "r2"), _SCORES)


@query("write_forecast", f"""WITH {OUTLOOK} SELECT series_key, step, ds, {rsql('yhat', 4, 'yhat')}
FROM forecast""")
def _(spark, folder):
    path = f"{shared_folder(spark)}/forecast-{uuid.uuid4().hex}"
    files.write_forecast(outlook(spark, folder)[1], path, "csv")
    back = spark.read.schema("series_key string, step int, ds date, yhat double").csv(
        path, header=True)
    return _round(back, {"yhat": 4})
