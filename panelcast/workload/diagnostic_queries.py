"""Queries over diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.operators import diagnostics as G
from panelcast.sources.tables import table
from panelcast.workload.base import (
    BRAND_MONTHLY,
    GLOBAL_DAILY,
    NATION_WEEKLY,
    PLACED,
    brand_monthly,
    global_daily,
    nation_weekly,
    query,
    rsql,
)


# Sums of money lie on a decimal grid; the digits are chosen off its rounding ties: three for the
# weekly panel (two decimals), none for the monthly one (four and more).
def _revenue_sql(ctes: str, label: str, digits: int) -> str:
    return (f"WITH {ctes} SELECT series_key, CAST({label} AS DATE) AS period, "
            f"{rsql('sum(y)', digits, 'revenue')} FROM series GROUP BY 1, 2")


@query("period_revenue", _revenue_sql(NATION_WEEKLY, "last_day(ds)", 3))
def _(spark, folder):
    out = G.period_revenue(nation_weekly(spark, folder), "W")
    return out.withColumn("revenue", rnd(F.col("revenue"), 3))


@query("period_revenue_yearly", _revenue_sql(BRAND_MONTHLY, "date_trunc('year', ds)", 0))
def _(spark, folder):
    out = G.period_revenue(brand_monthly(spark, folder), "MS")
    return out.withColumn("revenue", rnd(F.col("revenue"), 0))


@query("category_share", f"""WITH cells AS (SELECT o_orderpriority, o_orderstatus,
  sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
grid AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM cells),
  (SELECT DISTINCT o_orderstatus FROM cells))
SELECT o_orderpriority, o_orderstatus,
  {rsql('coalesce(v, 0) / sum(v) OVER (PARTITION BY o_orderpriority)', 6, 'share')}
FROM grid LEFT JOIN cells USING (o_orderpriority, o_orderstatus)""")
def _(spark, folder):
    orders = table(spark, folder, "orders")
    row, column = G.share_axes(orders, ("o_orderpriority",), ("o_orderstatus",))
    out = G.category_share(orders, row, column, "o_totalprice")
    return out.withColumn("share", rnd(F.col("share")))


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{b}' AS row, '{a}' AS col, {rsql(f'corr({a}, {b})', 6, 'r')} FROM lineitem"
    for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1:]))
def _(spark, folder):
    out = G.correlation_matrix(table(spark, folder, "lineitem"), _MEASURES)
    return out.withColumn("r", rnd(F.col("r")))


@query("linear_trend", f"""WITH {NATION_WEEKLY}, {PLACED}, fit AS (SELECT series_key,
  regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a FROM placed GROUP BY 1)
SELECT p.series_key, ds, {rsql('b', 4, 'slope')}, {rsql('a', 2, 'intercept')},
  {rsql('a + b * pos', 2, 'trend')} FROM placed p JOIN fit USING (series_key)""")
def _(spark, folder):
    out = G.linear_trend(nation_weekly(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("slope"), 4).alias("slope"),
                      rnd(F.col("intercept"), 2).alias("intercept"),
                      rnd(F.col("trend"), 2).alias("trend"))


def _ma(k: int) -> str:
    over = f"OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return rsql(f"CASE WHEN count(*) {over} = {k} THEN avg(y) {over} END", 6, f"ma_{k}")


@query("moving_average", f"WITH {NATION_WEEKLY} SELECT series_key, ds, {_ma(7)}, {_ma(30)} FROM series")
def _(spark, folder):
    out = G.moving_average(nation_weekly(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("ma_7")).alias("ma_7"),
                      rnd(F.col("ma_30")).alias("ma_30"))


@query("pct_change", f"""WITH {NATION_WEEKLY}, l AS (SELECT series_key, ds, y,
  lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS p FROM series)
SELECT series_key, ds, {rsql('(y - p) / nullif(p, 0) * 100', 4, 'pct')} FROM l""")
def _(spark, folder):
    out = G.pct_change(nation_weekly(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("pct"), 4).alias("pct"))


def _decompose_sql(ctes: str, m: int) -> str:
    h = m // 2
    over = f"OVER (PARTITION BY series_key ORDER BY ds ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    return f"""WITH {ctes}, {PLACED},
t AS (SELECT *, CASE WHEN count(*) {over} = {2 * h + 1} THEN avg(y) {over} END AS trend FROM placed),
s AS (SELECT *, avg(y - trend) OVER (PARTITION BY series_key, pos % {m}) AS seasonal FROM t
  WHERE n >= {2 * m})
SELECT series_key, ds, {rsql('y', 4, 'y')}, {rsql('trend', 6, 'trend')},
  {rsql('seasonal', 2, 'seasonal')}, {rsql('y - trend - seasonal', 2, 'residual')} FROM s"""


def _decomposed(df):
    return df.select("series_key", "ds", rnd(F.col("y"), 4).alias("y"),
                     rnd(F.col("trend"), 6).alias("trend"),
                     rnd(F.col("seasonal"), 2).alias("seasonal"),
                     rnd(F.col("residual"), 2).alias("residual"))


@query("seasonal_decompose", _decompose_sql(NATION_WEEKLY, 4))
def _(spark, folder):
    return _decomposed(G.seasonal_decompose(nation_weekly(spark, folder), 4))


@query("seasonal_decompose_daily", _decompose_sql(GLOBAL_DAILY, 7))
def _(spark, folder):
    return _decomposed(G.seasonal_decompose(global_daily(spark, folder), 7))


_ACF = f"""{PLACED},
d AS (SELECT series_key, pos, n, y - avg(y) OVER (PARTITION BY series_key) AS d FROM placed),
v AS (SELECT series_key, n, sum(d * d) AS c0 FROM d GROUP BY 1, 2),
ks AS (SELECT series_key, n, c0, CAST(unnest(range(0, greatest(least(40, n // 2 - 1), 0) + 1))
  AS INTEGER) AS lag FROM v),
r AS (SELECT k.series_key, k.lag, k.n, sum(a.d * b.d) / any_value(c0) AS r
  FROM ks k JOIN d a ON a.series_key = k.series_key
  JOIN d b ON b.series_key = k.series_key AND b.pos = a.pos - k.lag GROUP BY 1, 2, 3),
b AS (SELECT *, CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag >= 1
  THEN r * r END) OVER (PARTITION BY series_key ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING
  AND 1 PRECEDING), 0)) / n) END AS se FROM r)"""


@query("acf", f"""WITH {NATION_WEEKLY}, {_ACF}
SELECT series_key, lag, {rsql('r', 6, 'r')}, n, {rsql('1.96 / sqrt(n)', 6, 'band')} FROM r""")
def _(spark, folder):
    out = G.acf(nation_weekly(spark, folder))
    return out.withColumn("r", rnd(F.col("r"))).withColumn("band", rnd(F.col("band")))


@query("acf_bartlett", f"""WITH {NATION_WEEKLY}, {_ACF}
SELECT series_key, lag, {rsql('r', 6, 'r')}, {rsql('se', 6, 'se')},
 {rsql('r - CAST(1.959963984540054 AS DOUBLE) * se', 6, 'lower')},
 {rsql('r + CAST(1.959963984540054 AS DOUBLE) * se', 6, 'upper')} FROM b""")
def _(spark, folder):
    out = G.acf_bartlett(G.acf(nation_weekly(spark, folder)))
    return out.select("series_key", "lag",
                      *[rnd(F.col(c)).alias(c) for c in ("r", "se", "lower", "upper")])


def _lags_sql(ctes: str, limit: str) -> str:
    return f"""WITH {ctes}, {_ACF}, h AS (SELECT series_key, max(CASE WHEN lag >= 1 AND n >= 10
  AND abs(r) > {limit} THEN lag END) AS last FROM b GROUP BY 1)
SELECT series_key, CAST(coalesce(least(greatest(last, 7), 30), 7) AS INTEGER) AS lags
FROM (SELECT series_key, CASE WHEN last IS NULL THEN 7 ELSE last END AS last FROM h)"""


@query("optimal_lags", _lags_sql(NATION_WEEKLY, "CAST(1.959963984540054 AS DOUBLE) * se"))
def _(spark, folder):
    return G.optimal_lags(nation_weekly(spark, folder))


@query("optimal_lags_centred",
       _lags_sql(NATION_WEEKLY, "r + CAST(1.959963984540054 AS DOUBLE) * se"))
def _(spark, folder):
    return G.optimal_lags(nation_weekly(spark, folder), rule="centred")


# The recursion from lag k to k + 1, with the coefficients of lag k in a list.
_PACF = """
rho AS (SELECT series_key, list(r * n / (n - lag) ORDER BY lag) AS g, count(*) - 1 AS lags FROM r GROUP BY 1),
levels AS (SELECT series_key, g, lags, CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS p FROM rho
  UNION ALL SELECT series_key, g, lags, k + 1,
    list_append(list_transform(range(1, k + 1), lambda i: phi[i] - p1 * phi[k + 1 - i]), p1), p1
  FROM (SELECT *, (g[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * g[k + 2 - i])), 0))
    / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * g[i + 1])), 0)) AS p1
    FROM levels WHERE k < lags))"""


@query("pacf", f"""WITH RECURSIVE {NATION_WEEKLY}, {_ACF}, {_PACF}
SELECT series_key, CAST(k AS INTEGER) AS lag, {rsql('p', 6, 'pacf')} FROM levels""")
def _(spark, folder):
    return G.pacf(nation_weekly(spark, folder)).withColumn("pacf", rnd(F.col("pacf")))


@query("adf_test")
def _(spark, folder):
    return G.adf_test(nation_weekly(spark, folder))
