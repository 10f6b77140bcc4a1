"""Queries over series construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.functions.numeric import rnd
from panelcast.operators import series as S
from panelcast.sources.tables import read_sales_sums, read_sales_table, table
from panelcast.workload.base import (
    BRAND_MONTHLY,
    EVENT_DAILY,
    GLOBAL_DAILY,
    NATION_WEEKLY,
    PLACED,
    ROWS_BRAND,
    ROWS_EVENT,
    ROWS_NATION,
    SPLIT,
    brand_monthly,
    event_daily,
    filled,
    global_daily,
    nation_rows,
    nation_weekly,
    query,
    resampled,
    rsql,
    series_sql,
    trimmed,
)


def _out(df, digits: int = 4):
    return df.select("series_key", "ds", rnd(F.col("y"), digits).alias("y"))


def _sql(ctes: str, source: str, digits: int = 4) -> str:
    return f"WITH {ctes} SELECT series_key, ds, {rsql('y', digits, 'y')} FROM {source}"


@query("read_sales_table", f"WITH {ROWS_NATION} SELECT * FROM rows_")
def _(spark, folder):
    return nation_rows(spark, folder)


@query("read_sales_sums", f"""WITH {ROWS_NATION} SELECT series_key, ds, {rsql('sum(y)', 2, 'y')}
  FROM rows_ GROUP BY series_key, ds""")
def _(spark, folder):
    return _out(read_sales_sums(spark, folder, "orders", ("nation",)), 2)


@query("resample_sum", _sql(resampled(ROWS_NATION, "W"), "resampled"))
def _(spark, folder):
    return _out(S.resample_sum(nation_rows(spark, folder), "W"))


def _resample_other(freq):
    def run(spark, folder):
        rows = read_sales_table(spark, folder, "lineitem", ("brand",))
        return _out(S.resample_sum(rows, freq))

    return run


for _freq in ("D", "MS", "QS", "YS"):
    query(f"resample_sum_{_freq.lower()}", _sql(resampled(ROWS_BRAND, _freq), "resampled"))(
        _resample_other(_freq)
    )


@query("fill_gaps", _sql(filled(ROWS_NATION, "W"), "filled"))
def _(spark, folder):
    return _out(S.fill_gaps(S.resample_sum(nation_rows(spark, folder), "W"), "W"))


@query("spine_left_join", f"""WITH {filled(ROWS_EVENT, 'D')}
SELECT s.series_key, s.ds, {rsql('r.y', 4, 'y')} FROM spine s
LEFT JOIN resampled r ON r.series_key = s.series_key AND r.ds = s.ds""")
def _(spark, folder):
    rows = read_sales_table(spark, folder, "events", ("event_type",))
    return _out(S.spine_left_join(S.resample_sum(rows, "D"), "D"))


# Sales of quantities above 30 only start late in some series, which gives them empty heads.
_SPARSE = """
rows_ AS (SELECT p_brand AS series_key, CAST(l_shipdate AS DATE) AS ds,
    CASE WHEN l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-03-01'
         THEN l_quantity ELSE CAST(0 AS DOUBLE) END AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("trim_leading_zeros", _sql(trimmed(_SPARSE, "MS"), "trimmed"))
def _(spark, folder):
    facts = table(spark, folder, "lineitem").join(
        table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    late = (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1996-03-01").cast(
        "timestamp_ntz"))
    rows = facts.select(
        F.col("p_brand").alias("series_key"), F.col("l_shipdate").cast("date").alias("ds"),
        F.when(late, F.col("l_quantity")).otherwise(F.lit(0.0)).alias("y"),
    )
    return _out(S.trim_leading_zeros(S.fill_gaps(S.resample_sum(rows, "MS"), "MS")))


@query("winsorize", _sql(NATION_WEEKLY, "series"))
def _(spark, folder):
    return _out(nation_weekly(spark, folder))


@query("winsorize_train", f"""WITH {trimmed(ROWS_NATION, 'W')},
placed AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS pos,
    count(*) OVER (PARTITION BY series_key) AS n FROM trimmed),
cuts AS (SELECT series_key, quantile_cont(y, 0.005) AS lo, quantile_cont(y, 0.995) AS hi,
    stddev_samp(y) AS sd FROM placed WHERE pos < floor(n * CAST(0.8 AS DOUBLE)) GROUP BY 1)
SELECT t.series_key, t.ds, {rsql('CASE WHEN sd > 0 THEN least(greatest(t.y, lo), hi) ELSE t.y END',
                                 6, 'y')}
FROM trimmed t JOIN cuts USING (series_key)""")
def _(spark, folder):
    rows = S.fill_gaps(S.resample_sum(nation_rows(spark, folder), "W"), "W")
    return _out(S.winsorize(S.trim_leading_zeros(rows), fit_on="train"), 6)


def _summary(df):
    return S.series_summary(df).select(
        "series_key", "n", "first_ds", "last_ds", rnd(F.col("total"), 4).alias("total"),
        rnd(F.col("mean"), 2).alias("mean"), rnd(F.col("peak"), 4).alias("peak"), "usable",
    )


def _summary_sql(ctes):
    return f"""WITH {ctes} SELECT series_key, count(*) AS n, min(ds) AS first_ds,
max(ds) AS last_ds, {rsql('sum(y)', 4, 'total')}, {rsql('avg(y)', 2, 'mean')},
{rsql('max(y)', 4, 'peak')}, count(*) >= 20 AS usable FROM series GROUP BY series_key"""


@query("series_summary", _summary_sql(NATION_WEEKLY))
def _(spark, folder):
    return _summary(nation_weekly(spark, folder))


@query("series_summary_global", _summary_sql(GLOBAL_DAILY))
def _(spark, folder):
    return _summary(global_daily(spark, folder))


@query("series_summary_brand", _summary_sql(BRAND_MONTHLY))
def _(spark, folder):
    return _summary(brand_monthly(spark, folder))


_EVENT_WEEKLY = series_sql(ROWS_EVENT, "W")


@query("rejected_series", f"""WITH {_EVENT_WEEKLY}
SELECT series_key, count(*) AS n FROM series GROUP BY 1 HAVING count(*) < 20""")
def _(spark, folder):
    rows = read_sales_table(spark, folder, "events", ("event_type",))
    return S.split_usable(S.build_series(rows, "W"))[1]


@query("temporal_split", f"""WITH {NATION_WEEKLY}, {PLACED}
SELECT series_key, ds, {rsql('y', 4, 'y')},
CASE WHEN pos < floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM placed""")
def _(spark, folder):
    out = S.temporal_split(nation_weekly(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("y"), 4).alias("y"), "part")


@query("first_difference", f"""WITH {NATION_WEEKLY}, d AS (SELECT series_key, ds,
  y - lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS y FROM series)
SELECT series_key, ds, {rsql('y', 4, 'y')} FROM d WHERE y IS NOT NULL""")
def _(spark, folder):
    return _out(S.first_difference(nation_weekly(spark, folder)))


@query("integrate_forecast", f"""WITH {NATION_WEEKLY}, {SPLIT},
d AS (SELECT series_key, step, ds,
  y - lag(y) OVER (PARTITION BY series_key ORDER BY ds) AS dy FROM test),
lasts AS (SELECT series_key, arg_max(y, ds) AS last_y FROM train GROUP BY 1),
run AS (SELECT d.series_key, step, ds, last_y + sum(dy) OVER (PARTITION BY d.series_key
  ORDER BY step) AS level FROM d JOIN lasts USING (series_key) WHERE dy IS NOT NULL)
SELECT series_key, step, ds, {rsql('greatest(level, CAST(0 AS DOUBLE))', 4, 'yhat')} FROM run""")
def _(spark, folder):
    train, test = S.train_test(nation_weekly(spark, folder))
    changes = test.withColumn("yhat", F.col("y") - F.lag("y").over(S.by_time())).where(
        F.col("yhat").isNotNull()
    )
    out = S.integrate_forecast(changes.drop("y"), S.last_values(train))
    return out.select("series_key", "step", "ds", rnd(F.col("yhat"), 4).alias("yhat"))


_LOGGED = """
flags AS (SELECT series_key, min(y) >= 0 AND count(*) >= 10 AS use_log FROM series GROUP BY 1),
logged AS (SELECT s.series_key, ds, use_log, CASE WHEN use_log THEN ln(1 + y) ELSE y END AS y
  FROM series s JOIN flags USING (series_key))"""


@query("log1p_transform", f"""WITH {EVENT_DAILY}, {_LOGGED}
SELECT series_key, ds, {rsql('y', 6, 'y')}, use_log FROM logged""")
def _(spark, folder):
    out = S.log1p_transform(event_daily(spark, folder))
    return out.select("series_key", "ds", rnd(F.col("y"), 6).alias("y"), "use_log")


@query("expm1_inverse", f"""WITH {EVENT_DAILY}, {_LOGGED}, shifted AS (SELECT *,
  y * 2 - CASE WHEN day(ds) % 3 = 0 THEN 12 ELSE 0 END AS p FROM logged)
SELECT series_key, ds, {rsql('''greatest(CASE WHEN use_log
  THEN exp(p) - 1 ELSE p END,
  CAST(0 AS DOUBLE))''', 3, 'yhat')} FROM shifted""")
def _(spark, folder):
    logged = S.log1p_transform(event_daily(spark, folder))
    p = F.col("y") * 2 - F.when(F.dayofmonth("ds") % 3 == 0, 12).otherwise(0)
    return logged.select(
        "series_key", "ds", rnd(S.expm1_inverse(p, F.col("use_log")), 3).alias("yhat")
    )


@query("sanitize_numeric", """SELECT l_orderkey, l_linenumber, CASE
  WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1e10 AS DOUBLE) END
  ELSE round(l_discount / l_tax, 6) + CAST(0 AS DOUBLE) END AS ratio FROM lineitem""")
def _(spark, folder):
    # Discount over tax: 0/0 is not a number and x/0 infinite before the cleaning.
    d, t = F.col("l_discount"), F.col("l_tax")
    raw = (
        F.when((t == 0) & (d == 0), F.lit(float("nan")))
        .when(t == 0, F.lit(float("inf")))
        .otherwise(F.try_divide(d, t))
    )
    df = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("ratio"))
    fixed = S.sanitize_numeric(df, ["ratio"])
    return fixed.withColumn("ratio", rnd(F.col("ratio"), 6))


@query("standard_scale", f"""WITH {NATION_WEEKLY}, m AS (SELECT series_key, avg(y) AS a,
  stddev_pop(y) AS sd FROM series GROUP BY 1)
SELECT s.series_key, ds, {rsql('(y - a) / CASE WHEN sd > 0 THEN sd ELSE 1 END', 6, 'y_scaled')}
FROM series s JOIN m USING (series_key)""")
def _(spark, folder):
    out = S.standard_scale(nation_weekly(spark, folder), ["y"])
    return out.select("series_key", "ds", rnd(F.col("y_scaled"), 6).alias("y_scaled"))


@query("robust_scale", f"""WITH {NATION_WEEKLY}, m AS (SELECT series_key,
  quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c
  FROM series GROUP BY 1)
SELECT s.series_key, ds, {rsql('(y - b) / CASE WHEN c - a > 0 THEN c - a ELSE 1 END', 6,
                               'y_scaled')}
FROM series s JOIN m USING (series_key)""")
def _(spark, folder):
    out = S.robust_scale(nation_weekly(spark, folder), ["y"])
    return out.select("series_key", "ds", rnd(F.col("y_scaled"), 6).alias("y_scaled"))


