"""Diagnostics of series: shares, correlation, trend, decomposition, autocorrelation, unit root."""

from __future__ import annotations

from itertools import combinations
from math import erf, log, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.operators.series import by_key, by_time, with_position

MAX_ACF_LAG = 40
# 97.5 % quantile of the normal distribution.
Z95 = 1.959963984540054
# Column labels of a share table in one list, about.
LABELS = 1024


def period_revenue(series: DataFrame, freq: str) -> DataFrame:
    """Month-end sums of daily and weekly series, yearly sums of coarser ones."""
    label = F.last_day("ds") if freq in ("D", "W") else F.trunc("ds", "year")
    return series.groupBy("series_key", label.alias("period")).agg(F.sum("y").alias("revenue"))


# Columns tried, in order, for the rows and the columns of the share table.
SHARE_ROWS = ("Category", "Store_Type", "City", "Season", "Subcategory")
SHARE_COLUMNS = ("City", "Month", "Season", "Store_Type")


def share_axes(
    df: DataFrame, rows: tuple = SHARE_ROWS, columns: tuple = SHARE_COLUMNS,
    limit: tuple[int, int] | None = None,
) -> tuple[str, str] | None:
    """Row and column attribute of the share table, or nothing when there are none. ``limit`` is the
    most values of each that a chart takes, such as (20, 15)."""
    row = next((c for c in rows if c in df.columns), None)
    column = next((c for c in columns if c in df.columns and c != row), None)
    if row is None or column is None:
        return None
    if limit:
        sizes = df.agg(F.count_distinct(row), F.count_distinct(column)).first()
        if sizes[0] > limit[0] or sizes[1] > limit[1]:
            return None
    return row, column


def category_share(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Share of each column value in the row's total, with 0 where a pair does not occur.

    The facts are summed per cell first; everything after works on cells. Labels are kept in lists of
    about ``LABELS``, so many of them never meet in one array.
    """
    cells = df.groupBy(row, column).agg(F.sum(value).alias("v"))
    labels = cells.select(F.col(column).alias("_column")).where(F.col(column).isNotNull()).distinct()
    lists = max(1, -(-labels.count() // LABELS))
    listed = labels.groupBy(F.pmod(F.xxhash64("_column"), F.lit(lists)).cast("int").alias("_list")).agg(
        F.collect_list("_column").alias("_columns"))
    totals = cells.groupBy(row).agg(F.sum("v").alias("_total")).select(
        F.col(row).alias("_row"), "_total", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("_list")
    ).join(listed, "_list").select("_row", "_total", F.explode("_columns").alias("_column"))
    same = totals["_row"].eqNullSafe(cells[row]) & (totals["_column"] == cells[column])
    return totals.join(cells, same, "left").select(
        F.col("_row").alias(row), F.col("_column").alias(column),
        F.try_divide(F.coalesce("v", F.lit(0.0)), "_total").alias("share"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair, lower triangle, from one pass over the table."""
    if len(columns) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    pairs = list(combinations(columns, 2))
    cells = [
        F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.corr(a, b).alias("r"))
        for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def linear_trend(series: DataFrame) -> DataFrame:
    """Least-squares line over the position, with the fitted value of each row."""
    placed = with_position(series)
    key = by_key()
    slope = F.regr_slope(F.col("y"), F.col("pos").cast("double")).over(key)
    intercept = F.regr_intercept(F.col("y"), F.col("pos").cast("double")).over(key)
    return (
        placed.withColumn("slope", slope).withColumn("intercept", intercept)
        .select("series_key", "ds", "y", "slope", "intercept",
                (F.col("intercept") + F.col("slope") * F.col("pos")).alias("trend"))
    )


def moving_average(series: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing means including the current row; null until the window is full."""
    row = F.row_number().over(by_time())

    def mean(k: int) -> Column:
        return F.when(row >= k, F.avg("y").over(by_time().rowsBetween(-k + 1, 0)))

    return series.withColumns({f"ma_{k}": mean(k) for k in windows})


def pct_change(series: DataFrame) -> DataFrame:
    """Change against the previous period in percent; null after a zero."""
    prior = F.lag("y").over(by_time())
    return series.withColumn("pct", F.try_divide(F.col("y") - prior, prior) * 100)


def seasonal_decompose(series: DataFrame, period: int) -> DataFrame:
    """Trend by a centred mean, seasonal part by the mean detrended value of each phase, residual.

    Series shorter than two periods are left out.
    """
    half = period // 2
    frame = by_time().rowsBetween(-half, half)
    trend = F.when(F.count("y").over(frame) == 2 * half + 1, F.avg("y").over(frame))
    phase = Window.partitionBy("series_key", "phase")
    return (
        with_position(series).where(F.col("n") >= 2 * period)
        .withColumn("trend", trend)
        .withColumn("phase", F.col("pos") % period)
        .withColumn("seasonal", F.avg(F.col("y") - F.col("trend")).over(phase))
        .withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal"))
        .select("series_key", "ds", "y", "trend", "seasonal", "residual")
    )


def acf(series: DataFrame, max_lag: int = MAX_ACF_LAG) -> DataFrame:
    """Autocorrelation from lag 0 to min(40, n/2 − 1): ``(series_key, lag, r, n, band)``."""
    d = F.col("y") - F.avg("y").over(by_key())
    centred = series.select("series_key", "ds", d.alias("d"))
    lagged = centred.withColumns(
        {f"d{k}": F.lag("d", k).over(by_time()) for k in range(1, max_lag + 1)}
    )
    products = [F.sum(F.col("d") * F.col("d"))] + [
        F.sum(F.col("d") * F.col(f"d{k}")) for k in range(1, max_lag + 1)
    ]
    sums = lagged.groupBy("series_key").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.array(*products).alias("c")
    )
    reach = F.least(F.lit(max_lag), F.floor(F.col("n") / 2).cast("int") - 1)
    return (
        sums.select("series_key", "n", F.posexplode("c").alias("lag", "v"), F.col("c")[0].alias("c0"))
        .where(F.col("lag") <= F.greatest(reach, F.lit(0)))
        .select(
            "series_key", "lag",
            F.when(F.col("c0") > 0, F.coalesce("v", F.lit(0.0)) / F.col("c0")).alias("r"), "n",
            (F.lit(1.96) / F.sqrt("n")).alias("band"),
        )
    )


def acf_bartlett(correlations: DataFrame) -> DataFrame:
    """Standard error of each lag, growing with the correlations before it, and the interval."""
    earlier = (
        Window.partitionBy("series_key").orderBy("lag")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    past = F.sum(F.when(F.col("lag") >= 1, F.col("r") * F.col("r"))).over(earlier)
    se = F.sqrt((F.lit(1.0) + F.lit(2.0) * F.coalesce(past, F.lit(0.0))) / F.col("n"))
    half = F.lit(Z95) * F.col("se")
    return (
        correlations.withColumn("se", F.when(F.col("lag") == 0, F.lit(0.0)).otherwise(se))
        .withColumn("lower", F.col("r") - half)
        .withColumn("upper", F.col("r") + half)
    )


MIN_LAGS = 7
MAX_OPTIMAL_LAGS = 30


def optimal_lags(series: DataFrame, rule: str = "bartlett") -> DataFrame:
    """Last significant lag of each series, kept within 7 and 30.

    ``rule="bartlett"`` calls a lag significant when its correlation leaves the interval around 0;
    ``rule="centred"`` compares it with the upper end of the interval around itself.
    """
    bands = acf_bartlett(acf(series))
    limit = {"bartlett": F.lit(Z95) * F.col("se"), "centred": F.col("upper")}[rule]
    hit = (F.col("lag") >= 1) & (F.abs("r") > limit) & (F.col("n") >= 10)
    last = F.max(F.when(hit, F.col("lag")))
    bounded = F.least(F.greatest(last, F.lit(MIN_LAGS)), F.lit(MAX_OPTIMAL_LAGS))
    return bands.groupBy("series_key").agg(
        F.coalesce(F.when(last.isNotNull(), bounded), F.lit(MIN_LAGS)).cast("int").alias("lags")
    )


def partial_correlations(r: np.ndarray, n: int) -> np.ndarray:
    """Durbin–Levinson recursion over autocorrelations, with denominators n − k."""
    lags = len(r) - 1
    rho = r * n / (n - np.arange(lags + 1))
    rho = rho / rho[0]
    out = np.ones(lags + 1)
    phi = np.zeros(0)
    for k in range(1, lags + 1):
        above = rho[k] - phi @ rho[k - 1:0:-1]
        below = 1.0 - phi @ rho[1:k]
        last = above / below if below != 0 else np.nan
        phi = np.append(phi - last * phi[::-1], last)
        out[k] = last
    return out


def pacf(series: DataFrame) -> DataFrame:
    """Partial autocorrelation, from the at most 41 correlations of each series."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        r = pdf["r"].to_numpy(dtype=float)
        values = partial_correlations(r, int(pdf["n"].iloc[0])) if np.isfinite(r).all() else r
        return pd.DataFrame({"series_key": pdf["series_key"], "lag": pdf["lag"], "pacf": values})

    return acf(series).groupBy("series_key").applyInPandas(
        one, "series_key string, lag int, pacf double"
    )


# Published response-surface coefficients for the p-value of the unit-root test with constant
# (fixed values, one regressor): lower and upper branch, branch point and bounds.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74


def adf_p_value(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    weights = ADF_SMALL if stat <= ADF_STAR else ADF_LARGE
    z = sum(w * stat**i for i, w in enumerate(weights))
    return 0.5 * (1.0 + erf(z / sqrt(2.0)))


def _adf_design(y: np.ndarray, lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes, and the regressors level, constant and lagged changes, from row ``skip`` on."""
    dy = np.diff(y)
    columns = [y[skip:-1], np.ones(len(dy) - skip)]
    columns += [dy[skip - k:len(dy) - k] for k in range(1, lags + 1)]
    return dy[skip:], np.column_stack(columns)


def _aic(target: np.ndarray, x: np.ndarray) -> float:
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    n, ssr = len(target), float(np.sum((target - x @ beta) ** 2))
    return n * (log(2 * pi) + log(max(ssr / n, 1e-300)) + 1) + 2 * x.shape[1]


def adf_statistic(y: np.ndarray, lags: int | None = None) -> tuple[float, int]:
    """Test statistic with constant; the number of lagged changes minimises the AIC."""
    n = len(y)
    if n < 7 or np.ptp(y) == 0:
        raise ValueError("series too short or constant")
    if lags is None:
        most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)
        target, x = _adf_design(y, most, most)
        lags = min(range(most + 1), key=lambda k: _aic(target, x[:, :2 + k]))
    target, x = _adf_design(y, lags, lags)
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    residual = target - x @ beta
    scale = residual @ residual / (len(target) - x.shape[1])
    return float(beta[0] / np.sqrt(scale * np.linalg.pinv(x.T @ x)[0, 0])), lags


ADF_SCHEMA = (
    "series_key string, test_stat double, p_value double, lags_used int, is_stationary boolean"
)


def adf_test(series: DataFrame) -> DataFrame:
    """Augmented Dickey–Fuller test per series; a failure counts as not stationary with p = 1."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("ds")["y"].to_numpy(dtype=float)
        try:
            stat, lags = adf_statistic(y)
            p = adf_p_value(stat)
        except (ValueError, np.linalg.LinAlgError):
            stat, lags, p = 0.0, 0, 1.0
        row = (pdf["series_key"].iloc[0], stat, p, lags, p < 0.05)
        return pd.DataFrame([row], columns=[c.split()[0] for c in ADF_SCHEMA.split(", ")])

    return series.groupBy("series_key").applyInPandas(one, ADF_SCHEMA)
