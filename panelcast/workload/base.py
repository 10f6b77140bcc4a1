"""Registration of named queries with their reference SQL, and the shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.operators.series import build_series
from panelcast.session import ship_package
from panelcast.sources.tables import read_sales_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs to check it."""
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- the panels the queries run on -------------------------------------------------------------

def nation_rows(spark: SparkSession, folder: str) -> DataFrame:
    return read_sales_table(spark, folder, "orders", ("nation",))


def nation_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """25 series of weekly sales."""
    return build_series(nation_rows(spark, folder), "W")


def global_daily(spark: SparkSession, folder: str) -> DataFrame:
    """One daily series of all orders."""
    return build_series(read_sales_table(spark, folder, "orders"), "D")


def brand_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """25 series of monthly net sales."""
    return build_series(read_sales_table(spark, folder, "lineitem", ("brand",)), "MS")


def event_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Five short daily series."""
    return build_series(read_sales_table(spark, folder, "events", ("event_type",)), "D")


# --- the same panels in SQL --------------------------------------------------------------------

ROWS_NATION = """
rows_ AS (SELECT n_name AS series_key, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL)"""

ROWS_GLOBAL = """
rows_ AS (SELECT 'all' AS series_key, CAST(o_orderdate AS DATE) AS ds, o_totalprice AS y
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL)"""

ROWS_BRAND = """
rows_ AS (SELECT p_brand AS series_key, CAST(l_shipdate AS DATE) AS ds,
    l_extendedprice * (CAST(1 AS DOUBLE) - l_discount) AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate IS NOT NULL
    AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)"""

ROWS_EVENT = """
rows_ AS (SELECT event_type AS series_key, CAST(ts AS DATE) AS ds, value AS y
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""

_PERIOD = {
    "D": "ds",
    "W": "CAST(date_trunc('week', ds) AS DATE) + 6",
    "MS": "CAST(date_trunc('month', ds) AS DATE)",
    "QS": "CAST(date_trunc('quarter', ds) AS DATE)",
    "YS": "CAST(date_trunc('year', ds) AS DATE)",
}
STEP = {"D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAY", "MS": "INTERVAL 1 MONTH",
        "QS": "INTERVAL 3 MONTH", "YS": "INTERVAL 1 YEAR"}


def resampled(rows: str, freq: str) -> str:
    return f"""{rows},
resampled AS (SELECT series_key, CAST({_PERIOD[freq]} AS DATE) AS ds, sum(y) AS y
  FROM rows_ GROUP BY 1, 2)"""


def filled(rows: str, freq: str) -> str:
    return f"""{resampled(rows, freq)},
spine AS (SELECT series_key, CAST(unnest(generate_series(CAST(min(ds) AS TIMESTAMP),
    CAST(max(ds) AS TIMESTAMP), {STEP[freq]})) AS DATE) AS ds FROM resampled GROUP BY series_key),
filled AS (SELECT s.series_key, s.ds, coalesce(r.y, CAST(0 AS DOUBLE)) AS y FROM spine s
  LEFT JOIN resampled r ON r.series_key = s.series_key AND r.ds = s.ds)"""


def trimmed(rows: str, freq: str) -> str:
    return f"""{filled(rows, freq)},
firsts AS (SELECT series_key, min(CASE WHEN y > 0 THEN ds END) AS f FROM filled GROUP BY 1),
trimmed AS (SELECT t.series_key, t.ds, t.y FROM filled t JOIN firsts USING (series_key)
  WHERE f IS NULL OR t.ds >= f)"""


def series_sql(rows: str, freq: str) -> str:
    """CTE ``series``: the built panel."""
    return f"""{trimmed(rows, freq)},
cuts AS (SELECT series_key, quantile_cont(y, 0.005) AS lo, quantile_cont(y, 0.995) AS hi,
    stddev_samp(y) AS sd FROM trimmed GROUP BY 1),
series AS (SELECT t.series_key, t.ds, CASE WHEN sd > 0 THEN least(greatest(t.y, lo), hi)
    ELSE t.y END AS y FROM trimmed t JOIN cuts USING (series_key))"""


NATION_WEEKLY = series_sql(ROWS_NATION, "W")
GLOBAL_DAILY = series_sql(ROWS_GLOBAL, "D")
BRAND_MONTHLY = series_sql(ROWS_BRAND, "MS")
EVENT_DAILY = series_sql(ROWS_EVENT, "D")

# CTEs over ``series``: position, hold-out split.
PLACED = """
placed AS (SELECT series_key, ds, y,
    CAST(row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS INTEGER) AS pos,
    CAST(count(*) OVER (PARTITION BY series_key) AS INTEGER) AS n FROM series)"""
SPLIT = PLACED + """,
cutoff AS (SELECT *, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS INTEGER) AS cut FROM placed),
train AS (SELECT series_key, ds, y, pos, cut AS n FROM cutoff WHERE pos < cut),
test AS (SELECT series_key, CAST(pos - cut + 1 AS INTEGER) AS step, ds, y FROM cutoff
  WHERE pos >= cut)"""


def rsql(expr: str, digits: int, alias: str) -> str:
    """Rounded output column."""
    return f"round({expr}, {digits}) + CAST(0 AS DOUBLE) AS {alias}"
