"""Queries over the natively computed forecasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.models.autoregressive import AR, AR1
from panelcast.models.baseline import Naive, SeasonalNaive
from panelcast.models.smoothing import HoltWinters
from panelcast.operators.series import train_test
from panelcast.workload.base import (
    EVENT_DAILY,
    NATION_WEEKLY,
    SPLIT,
    event_daily,
    nation_weekly,
    query,
    rsql,
)

SEASON = 4

# CTEs with the baselines' forecasts of the hold-out: (series_key, model, step, ds, y, yhat).
NAIVE_SQL = """
naive AS (SELECT t.series_key, 'naive' AS model, t.step, t.ds, t.y, a.yhat FROM test t JOIN
  (SELECT series_key, avg(y) AS yhat FROM train WHERE pos >= n - 7 GROUP BY 1) a
  USING (series_key))"""


def snaive_sql(k: int) -> str:
    return f"""
snaive AS (SELECT t.series_key, 'seasonal_naive' AS model, t.step, t.ds, t.y,
  greatest(coalesce(r.y, l.y), CAST(0 AS DOUBLE)) AS yhat
  FROM test t JOIN (SELECT series_key, max(n) AS n, arg_max(y, pos) AS y FROM train GROUP BY 1) l
    USING (series_key)
  LEFT JOIN train r ON r.series_key = t.series_key
    AND r.pos = greatest(l.n - {k}, 0) + (least(l.n, {k}) + t.step - 1) % {k})"""


AR1_SQL = """
pairs AS (SELECT series_key, y, lag(y) OVER (PARTITION BY series_key ORDER BY pos) AS x FROM train),
ar1_fit AS (SELECT series_key, coalesce(regr_slope(y, x), 0) AS b,
  coalesce(regr_intercept(y, x), avg(y)) AS a FROM pairs WHERE x IS NOT NULL GROUP BY 1),
ar1_path AS (SELECT f.series_key, 0 AS step, arg_max(t.y, t.pos) AS v, any_value(f.a) AS a,
    any_value(f.b) AS b FROM ar1_fit f JOIN train t USING (series_key) GROUP BY 1
  UNION ALL SELECT series_key, step + 1, greatest(a + b * v, CAST(0 AS DOUBLE)), a, b
  FROM ar1_path WHERE step < 400),
ar1 AS (SELECT t.series_key, 'ar1' AS model, t.step, t.ds, t.y, p.v AS yhat FROM test t
  JOIN ar1_path p ON p.series_key = t.series_key AND p.step = t.step)"""

HW_SQL = """
hw_len AS (SELECT series_key, max(n) AS n, CASE WHEN max(n) < 2 * {m}
    THEN greatest(2, max(n) // 4) ELSE {m} END AS m, list(y ORDER BY pos) AS ys
  FROM train GROUP BY 1),
hw_init AS (SELECT *, list_avg(ys[1:m]) AS l0 FROM hw_len WHERE n >= m),
hw_path AS (SELECT series_key, n, m, ys, 0 AS i, l0 AS l,
    CASE WHEN n >= 2 * m THEN (list_avg(ys[m + 1:2 * m]) - l0) / m ELSE CAST(0 AS DOUBLE) END AS t,
    list_transform(ys[1:m], lambda v: v - l0) AS s FROM hw_init
  UNION ALL SELECT series_key, n, m, ys, i + 1,
    {a} * (ys[i + 1] - s[1]) + {a1} * (l + t),
    {b} * (({a} * (ys[i + 1] - s[1]) + {a1} * (l + t)) - l) + {b1} * t,
    list_append(s[2:], {b} * (ys[i + 1] - l) + {b1} * s[1])
  FROM hw_path WHERE i < n),
hw AS (SELECT t.series_key, 'holt_winters' AS model, t.step, t.ds, t.y,
  greatest(p.l + t.step * p.t + p.s[(t.step - 1) % p.m + 1], CAST(0 AS DOUBLE)) AS yhat
  FROM test t JOIN hw_path p ON p.series_key = t.series_key AND p.i = p.n)"""


def hw_sql(m: int) -> str:
    d = "CAST({} AS DOUBLE)"
    return HW_SQL.format(m=m, a=d.format(0.3), a1=d.format(0.7), b=d.format(0.1), b1=d.format(0.9))


def baselines_sql(panel: str, season: int = SEASON) -> str:
    """CTE ``scored`` with four forecasters over the hold-out of a panel."""
    return f"""{panel}, {SPLIT}, {NAIVE_SQL}, {snaive_sql(season)}, {AR1_SQL}, {hw_sql(season)},
scored AS (SELECT * FROM naive UNION ALL SELECT * FROM snaive UNION ALL SELECT * FROM ar1
  UNION ALL SELECT * FROM hw)"""


def baselines(season: int = SEASON) -> list:
    return [Naive(), SeasonalNaive(season), AR1(), HoltWinters(season=season)]


def _model_query(name: str, model, ctes: str, source: str, panel=nation_weekly,
                 panel_sql: str = NATION_WEEKLY, digits: int = 2) -> None:
    def run(spark, folder):
        train, test = train_test(panel(spark, folder))
        out = model.forecast(train, test.drop("y"))
        return out.select("series_key", "step", "ds", rnd(F.col("yhat"), digits).alias("yhat"))

    sql = None
    if ctes:
        sql = (f"WITH RECURSIVE {panel_sql}, {SPLIT}, {ctes} SELECT series_key, step, ds, "
               f"{rsql('yhat', digits, 'yhat')} FROM {source}")
    query(name, sql)(run)


_model_query("model_naive", Naive(), NAIVE_SQL, "naive")
_model_query("model_seasonal_naive", SeasonalNaive(SEASON), snaive_sql(SEASON), "snaive")
# 24 training days against a season of 30: the season is longer than the history.
_model_query("model_seasonal_naive_short", SeasonalNaive(30), snaive_sql(30), "snaive",
             event_daily, EVENT_DAILY)
_model_query("model_ar1", AR1(), AR1_SQL, "ar1")
_model_query("model_holt_winters", HoltWinters(season=SEASON), hw_sql(SEASON), "hw")
_model_query("model_holt_winters_short", HoltWinters(season=15), hw_sql(15), "hw",
             event_daily, EVENT_DAILY)


def ar_sql(p: int, most: int = 400) -> str:
    """Normal equations of the centred lags, solved by elimination over a list of rows, then the recursion.
    Lags that depend on each other give null here, where the engine takes the shortest solution."""
    lags = ", ".join(f"lag(y, {k}) OVER w AS x{k}" for k in range(1, p + 1))
    each = " UNION ALL ".join(f"SELECT series_key, pos, {k} AS j, x{k} - mean AS v FROM lagged" for k in range(1, p + 1))
    return f"""
centre AS (SELECT series_key, avg(y) AS mean, list(y ORDER BY pos DESC)[1:{p}] AS newest FROM train GROUP BY 1),
lagged AS (SELECT * FROM (SELECT series_key, pos, y, mean, {lags} FROM train JOIN centre USING (series_key)
  WINDOW w AS (PARTITION BY series_key ORDER BY pos)) WHERE x{p} IS NOT NULL),
long AS (SELECT series_key, pos, 0 AS j, CAST(1 AS DOUBLE) AS v FROM lagged UNION ALL {each}
  UNION ALL SELECT series_key, pos, {p + 1}, y - mean FROM lagged),
moments AS (SELECT a.series_key, a.j AS i, b.j, sum(a.v * b.v) AS s FROM long a
  JOIN long b ON a.series_key = b.series_key AND a.pos = b.pos WHERE a.j <= {p} GROUP BY 1, 2, 3),
solved AS (SELECT series_key, list(line ORDER BY i) AS m, 1 AS k FROM
    (SELECT series_key, i, list(s ORDER BY j) AS line FROM moments GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT series_key, list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 3}), lambda j:
    CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] / m[k][k] * m[k][j] END)), k + 1
  FROM solved WHERE k <= {p + 1}),
ar_fit AS (SELECT series_key, mean, newest, list_transform(m, lambda line: line[{p + 2}]) AS beta
  FROM solved JOIN centre USING (series_key) WHERE k = {p + 2}),
ar_path AS (SELECT series_key, beta, mean, newest AS h, 0 AS step, CAST(NULL AS DOUBLE) AS yhat FROM ar_fit
  UNION ALL SELECT series_key, beta, mean, list_prepend(v, h[1:{p - 1}]), step + 1, v FROM
    (SELECT *, greatest(mean + beta[1] + list_sum(list_transform(range(1, {p + 1}), lambda i: beta[i + 1] * (h[i] - mean))),
      CAST(0 AS DOUBLE)) AS v FROM ar_path WHERE step < {most})),
ar AS (SELECT t.series_key, t.step, t.ds, q.yhat FROM test t JOIN ar_path q ON q.series_key = t.series_key AND q.step = t.step)"""


_model_query("model_ar", AR(14), ar_sql(14), "ar", digits=0)
