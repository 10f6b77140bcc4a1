"""From transactions to uniform series: clean, resample, fill, trim, clip, split, transform.

All functions take and return long frames ``(series_key, ds, y)`` and work on every series of the
panel in one job. Facts are summed map-side before the first exchange, so a hot key costs one row
per period and task; everything after works on at most one row per key and period.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.dates import parse_timestamp
from panelcast.functions.freq import period_of, step_interval
from panelcast.functions.numeric import clip, finite_or
from panelcast.spec import SeriesSpec, validate

MIN_PERIODS = 20
ALL = "all"


def by_key() -> Window:
    return Window.partitionBy("series_key")


def by_time() -> Window:
    return Window.partitionBy("series_key").orderBy("ds")


def key_of(keys: tuple[str, ...] | list[str]) -> Column:
    """One string key from the key columns; the constant ``all`` when there are none."""
    if not keys:
        return F.lit(ALL)
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("(none)")) for k in keys]
    return reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts)


def as_day(column: Column, dtype: str) -> Column:
    """Date of a column; text that is no date becomes null."""
    if dtype.startswith("timestamp") or dtype == "date":
        return column.cast("date")
    return parse_timestamp(column.cast("string")).cast("date")


def clean_sales(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Numbers and dates parsed, rows without either dropped: ``(series_key, ds, y)``."""
    validate(df, spec)
    types = dict(df.dtypes)
    target = F.col(spec.target)
    numeric = target.try_cast("double") if types[spec.target] == "string" else target.cast("double")
    return df.select(
        key_of(spec.keys).alias("series_key"),
        as_day(F.col(spec.date_col), types[spec.date_col]).alias("ds"),
        F.when(~F.isnan(numeric), numeric).alias("y"),
    ).na.drop(subset=["ds", "y"])


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when nothing is left after cleaning."""
    if df.isEmpty():
        raise ValueError("no valid rows remain after parsing")
    return df


def resample_sum(df: DataFrame, freq: str) -> DataFrame:
    """Sum of the target per series and period."""
    return df.groupBy("series_key", period_of(F.col("ds"), freq).alias("ds")).agg(
        F.sum("y").alias("y")
    )


def fill_gaps(series: DataFrame, freq: str) -> DataFrame:
    """Insert the missing periods with value 0.

    Each row emits itself and the empty periods up to its successor. That needs one window and no
    join against a calendar, and it leaves the rows partitioned by ``series_key`` for what follows.
    """
    run = F.sequence(F.col("_ds"), F.col("_next"), step_interval(freq))
    # The run ends with the successor, which emits its own row.
    own = F.when(F.col("_next").isNull(), F.array("_ds")).otherwise(
        F.slice(run, F.lit(1), F.size(run) - 1)
    )
    return (
        series.select("series_key", F.col("ds").alias("_ds"), "y",
                      F.lead("ds").over(by_time()).alias("_next"))
        .select("series_key", "_ds", "y", F.explode(own).alias("ds"))
        .select(
            "series_key", "ds",
            F.when(F.col("ds") == F.col("_ds"), F.col("y")).otherwise(F.lit(0.0)).alias("y"),
        )
    )


def spine(series: DataFrame, freq: str) -> DataFrame:
    """Every period between the first and the last of each series."""
    bounds = series.groupBy("series_key").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    return bounds.select(
        "series_key", F.explode(F.sequence("lo", "hi", step_interval(freq))).alias("ds")
    )


def spine_left_join(series: DataFrame, freq: str) -> DataFrame:
    """Calendar of each series joined with its facts; ``y`` is null where there are none."""
    return spine(series, freq).join(series, ["series_key", "ds"], "left")


def trim_leading_zeros(series: DataFrame) -> DataFrame:
    """Drop what lies before the first positive value; a series without one stays whole."""
    first = F.min(F.when(F.col("y") > 0, F.col("ds"))).over(by_key())
    return (
        series.withColumn("_first", first)
        .where(F.col("_first").isNull() | (F.col("ds") >= F.col("_first")))
        .drop("_first")
    )


def winsorize(
    series: DataFrame, lower: float = 0.005, upper: float = 0.995, fit_on: str = "all",
    train_ratio: float = 0.8, exact: bool = True,
) -> DataFrame:
    """Clip at two quantiles per series, unless the series is constant.

    ``fit_on="train"`` takes the quantiles from the first part of each series only, so that the
    hold-out does not leak into the clip. ``exact=False`` uses the approximate sketch.
    """
    y = F.col("y")
    frame = series
    if fit_on == "train":
        frame = with_position(frame)
        sample = F.when(F.col("pos") < split_point(F.col("n"), train_ratio), y)
    elif fit_on == "all":
        sample = y
    else:
        raise ValueError("fit_on is 'all' or 'train'")
    levels = F.array(F.lit(float(lower)), F.lit(float(upper)))
    cut = F.percentile(sample, levels) if exact else F.percentile_approx(sample, levels, 10000)
    key = by_key()
    return (
        frame.withColumn("_cut", cut.over(key))
        .withColumn("_sd", F.stddev_samp(sample).over(key))
        .select(
            "series_key", "ds",
            F.when(F.col("_sd") > 0, clip(y, F.col("_cut")[0], F.col("_cut")[1]))
            .otherwise(y).alias("y"),
        )
    )


def build_series(
    rows: DataFrame, freq: str, fit_on: str = "all", lower: float = 0.005, upper: float = 0.995
) -> DataFrame:
    """The whole construction: resample, fill, trim, clip."""
    filled = fill_gaps(resample_sum(rows, freq), freq)
    return winsorize(trim_leading_zeros(filled), lower, upper, fit_on=fit_on)


def series_summary(series: DataFrame, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Length, range and level of each series; ``usable`` is false below the minimum length."""
    n = F.count(F.lit(1))
    return series.groupBy("series_key").agg(
        n.alias("n"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.sum("y").alias("total"),
        F.avg("y").alias("mean"),
        F.max("y").alias("peak"),
        (n >= min_periods).alias("usable"),
    )


def split_usable(series: DataFrame, min_periods: int = MIN_PERIODS) -> tuple[DataFrame, DataFrame]:
    """Series long enough to model, and the rejected ones with their length."""
    sized = series.withColumn("n", F.count(F.lit(1)).over(by_key()))
    usable = sized.where(F.col("n") >= min_periods).drop("n")
    rejected = (
        series.groupBy("series_key").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") < min_periods)
    )
    return usable, rejected


def with_position(series: DataFrame) -> DataFrame:
    """0-based position ``pos`` of each row and the length ``n`` of its series."""
    return series.withColumn("pos", F.row_number().over(by_time()) - 1).withColumn(
        "n", F.count(F.lit(1)).over(by_key()).cast("int")
    )


def split_point(n: Column, train_ratio: float = 0.8) -> Column:
    return F.floor(n * F.lit(float(train_ratio))).cast("int")


def temporal_split(series: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """Mark the first floor(ratio·n) rows of each series as ``train``, the rest as ``test``."""
    part = F.when(F.col("pos") < split_point(F.col("n"), train_ratio), "train").otherwise("test")
    return with_position(series).withColumn("part", part).drop("pos", "n")


def train_test(series: DataFrame, train_ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Training rows, and test rows with their 1-based ``step``."""
    cut = split_point(F.col("n"), train_ratio)
    placed = with_position(series).withColumn("_cut", cut)
    train = placed.where(F.col("pos") < F.col("_cut")).drop("pos", "n", "_cut")
    test = placed.where(F.col("pos") >= F.col("_cut")).select(
        "series_key", (F.col("pos") - F.col("_cut") + 1).cast("int").alias("step"), "ds", "y"
    )
    return train, test


def first_difference(series: DataFrame) -> DataFrame:
    """Change against the previous period; the first row of each series goes."""
    return (
        series.withColumn("dy", F.col("y") - F.lag("y").over(by_time()))
        .where(F.col("dy").isNotNull())
        .select("series_key", "ds", F.col("dy").alias("y"))
    )


def integrate_forecast(changes: DataFrame, last: DataFrame) -> DataFrame:
    """Add predicted changes up from the last level.

    ``changes`` has ``(series_key, step, ds, yhat)`` and ``last`` ``(series_key, last_y)``. Only the
    output is kept at or above 0, the running level is not.
    """
    running = F.sum("yhat").over(
        Window.partitionBy("series_key").orderBy("step")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    level = F.col("last_y") + F.col("_run")
    return (
        changes.withColumn("_run", running)
        .join(last, "series_key")
        .select("series_key", "step", "ds", F.greatest(level, F.lit(0.0)).alias("yhat"))
    )


def last_values(series: DataFrame) -> DataFrame:
    """Newest date and value of each series."""
    newest = F.max(F.struct("ds", "y"))
    return series.groupBy("series_key").agg(newest.alias("_m")).select(
        "series_key", F.col("_m.ds").alias("last_ds"), F.col("_m.y").alias("last_y")
    )


LOG_MIN_LENGTH = 10


def log1p_transform(series: DataFrame, enabled: bool = True) -> DataFrame:
    """Natural log of 1 + y for series without negative values and with at least ten rows.

    Adds ``use_log`` so the inverse knows which series to undo.
    """
    key = by_key()
    flag = (F.min("y").over(key) >= 0) & (F.count(F.lit(1)).over(key) >= LOG_MIN_LENGTH)
    flag = flag if enabled else F.lit(False)
    return series.withColumn("use_log", flag).withColumn(
        "y", F.when(F.col("use_log"), F.log1p("y")).otherwise(F.col("y"))
    )


# The exponential of more than 709 is not a number any more; predictions have no other bound.
LOG_LIMIT = 700.0
LIMIT = 1e300


def bound_prediction(
    p: Column, use_log: Column, log_bounds: tuple[float, float] | None = None,
    bounds: tuple[float, float] | None = None,
) -> Column:
    """Finite predictions. ``log_bounds`` and ``bounds`` cut them in log space and in plain space;
    by default only what a number cannot hold is cut."""
    clean = finite_or(p, 0.0, LIMIT, -LIMIT)
    return F.when(use_log, clip(clean, *(log_bounds or (-LOG_LIMIT, LOG_LIMIT)))).otherwise(
        clip(clean, *(bounds or (-LIMIT, LIMIT))))


def expm1_inverse(p: Column, use_log: Column, signed: bool = False, **limits) -> Column:
    """Back to the original scale, at or above 0 unless ``signed``; ``limits`` as in
    ``bound_prediction``."""
    bounded = bound_prediction(p, use_log, **limits)
    level = F.when(use_log, F.expm1(bounded)).otherwise(bounded)
    return level if signed else F.greatest(level, F.lit(0.0))


def sanitize_numeric(df: DataFrame, columns: list[str], bound: float = 1e10) -> DataFrame:
    """NaN and null to 0, the infinities to plus or minus ``bound``, in all named columns."""
    fixed = {c: finite_or(F.col(c), 0.0, bound, -bound) for c in columns}
    return df.withColumns({c: clip(x, -1e15, 1e15) for c, x in fixed.items()})


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − mean) / population deviation per series; a constant column becomes 0."""
    key = by_key()

    def scaled(c: str) -> Column:
        sd = F.stddev_pop(c).over(key)
        return (F.col(c) - F.avg(c).over(key)) / F.when(sd > 0, sd).otherwise(F.lit(1.0))

    return df.withColumns({f"{c}_scaled": scaled(c) for c in columns})


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − median) / interquartile range per series; a zero range counts as 1."""
    key = by_key()
    quarters = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))

    def scaled(c: str) -> Column:
        q = F.percentile(c, quarters).over(key)
        spread = q[2] - q[0]
        return (F.col(c) - q[1]) / F.when(spread > 0, spread).otherwise(F.lit(1.0))

    return df.withColumns({f"{c}_scaled": scaled(c) for c in columns})
