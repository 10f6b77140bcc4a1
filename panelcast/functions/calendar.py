"""Calendar features of a date, all as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (month, day) of the festivals that raise sales.
FESTIVALS = (
    (10, 24), (3, 25), (4, 10), (10, 12), (12, 25), (1, 1),
    (8, 15), (1, 26), (8, 19), (11, 1), (10, 3),
)
FESTIVAL_REACH = 14
# Days of the month salaries are paid around.
PAYDAYS = (1, 2, 15, 16, 30, 31)
PAYDAY_CENTRES = (1, 15, 30)
TREND_EPOCH = "2020-01-01"
TREND_BOUND = 5000


def calendar_parts(ds: Column) -> dict[str, Column]:
    """Plain parts; Monday is day 0 of the week, weeks are ISO weeks."""
    return {
        "year": F.year(ds),
        "month": F.month(ds),
        "day": F.dayofmonth(ds),
        "dayofweek": F.weekday(ds),
        "dayofyear": F.dayofyear(ds),
        "quarter": F.quarter(ds),
        "weekofyear": F.weekofyear(ds),
    }


def calendar_flags(ds: Column) -> dict[str, Column]:
    weekend = (F.weekday(ds) >= 5).cast("int")
    return {
        "is_weekend": weekend,
        "is_month_start": (F.dayofmonth(ds) == 1).cast("int"),
        "is_month_end": (F.last_day(ds) == ds).cast("int"),
        "is_quarter_start": (F.trunc(ds, "quarter") == ds).cast("int"),
        "is_weekend_month": weekend * F.month(ds),
    }


def payday_features(ds: Column) -> dict[str, Column]:
    day = F.dayofmonth(ds)
    return {
        "is_payday": day.isin(*PAYDAYS).cast("int"),
        "dist_payday": F.least(*[F.abs(day - c) for c in PAYDAY_CENTRES]),
    }


def _wave(x: Column, k: int, period: float) -> Column:
    """The angle of the k-th harmonic."""
    return F.lit(2.0) * F.pi() * F.lit(float(k)) * x / F.lit(float(period))


def _harmonics(x: Column, period: float, count: int, sin: str, cos: str) -> dict[str, Column]:
    out = {}
    for k in range(1, count + 1):
        out[sin.format(k)] = F.sin(_wave(x, k, period))
        out[cos.format(k)] = F.cos(_wave(x, k, period))
    return out


def fourier_month_dow(ds: Column) -> dict[str, Column]:
    return {
        "month_sin": F.sin(_wave(F.month(ds), 1, 12)),
        "month_cos": F.cos(_wave(F.month(ds), 1, 12)),
        "dow_sin": F.sin(_wave(F.weekday(ds), 1, 7)),
        "dow_cos": F.cos(_wave(F.weekday(ds), 1, 7)),
    }


def fourier_annual(ds: Column) -> dict[str, Column]:
    return _harmonics(F.dayofyear(ds), 365.25, 3, "sin_{}", "cos_{}")


def fourier_monthly(ds: Column) -> dict[str, Column]:
    return _harmonics(F.dayofmonth(ds), 30.4375, 2, "month_sin_{}", "month_cos_{}")


def fourier_weekly(ds: Column) -> dict[str, Column]:
    return _harmonics(F.weekday(ds), 7, 3, "dow_sin_{}", "dow_cos_{}")


def by_day_of_year(ds: Column, value: Callable[[date], float]) -> Column:
    """A value that depends on the day within the year, looked up by position.

    The 365 and 366 values come from ``value`` on a common and a leap year and enter the plan as two
    constant arrays, so the row pays for one array access.
    """
    def table(year: int) -> str:
        first = date(year, 1, 1)
        days = (date(year + 1, 1, 1) - first).days
        return ",".join(f"{value(first + timedelta(i))!r}D" for i in range(days))

    leap = F.dayofyear(F.make_date(F.year(ds), F.lit(12), F.lit(31))) == 366
    slot = F.dayofyear(ds) - 1
    common, long = F.expr(f"array({table(2023)})"), F.expr(f"array({table(2024)})")
    return F.when(leap, F.get(long, slot)).otherwise(F.get(common, slot))


def nearest_festival(day: date) -> float:
    gaps = (abs((day - date(day.year, m, d)).days) for m, d in FESTIVALS)
    return max(0.0, (FESTIVAL_REACH + 1 - min(gaps)) / (FESTIVAL_REACH + 1))


def festival_score(ds: Column) -> Column:
    """Nearness to the closest festival of the same year: 1 on the day, 0 from 15 days on."""
    return by_day_of_year(ds, nearest_festival)


def festival_features(ds: Column) -> dict[str, Column]:
    score = festival_score(ds)
    return {"festival_score": score, "near_festival": (score > 0).cast("int")}


def trend_features(ds: Column) -> dict[str, Column]:
    days = F.date_diff(ds, F.lit(TREND_EPOCH).cast("date"))
    trend = F.least(F.greatest(days, F.lit(-TREND_BOUND)), F.lit(TREND_BOUND))
    return {"trend": trend, "trend_sq": F.pow(trend / F.lit(100.0), F.lit(2.0))}


def interaction_features(ds: Column) -> dict[str, Column]:
    score = festival_score(ds)
    weekend = calendar_flags(ds)["is_weekend"]
    scaled = trend_features(ds)["trend"] / F.lit(100.0)
    return {
        "fest_trend": score * scaled,
        "fest_weekend": score * weekend,
        "payday_weekend": payday_features(ds)["is_payday"] * weekend,
        "trend_month": scaled * fourier_month_dow(ds)["month_sin"],
        "trend_dow": scaled * fourier_weekly(ds)["dow_sin_1"],
    }


def calendar_features(ds: Column) -> dict[str, Column]:
    """Every feature that depends on the date alone."""
    groups = (
        calendar_parts, calendar_flags, payday_features, fourier_month_dow, fourier_annual,
        fourier_monthly, fourier_weekly, festival_features, trend_features, interaction_features,
    )
    return reduce(lambda a, g: {**a, **g(ds)}, groups, {})


CALENDAR_NAMES = (
    "year", "month", "day", "dayofweek", "dayofyear", "quarter", "weekofyear",
    "is_weekend", "is_month_start", "is_month_end", "is_quarter_start", "is_weekend_month",
    "is_payday", "dist_payday",
    "month_sin", "month_cos", "dow_sin", "dow_cos",
    "sin_1", "cos_1", "sin_2", "cos_2", "sin_3", "cos_3",
    "month_sin_1", "month_cos_1", "month_sin_2", "month_cos_2",
    "dow_sin_1", "dow_cos_1", "dow_sin_2", "dow_cos_2", "dow_sin_3", "dow_cos_3",
    "festival_score", "near_festival",
    "trend", "trend_sq",
    "fest_trend", "fest_weekend", "payday_weekend", "trend_month", "trend_dow",
)


def festival_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """Lookup of every date near a festival with its score: ``(ds, score)``.

    A range join "within 14 days" becomes an equality join on the date once each festival is
    unrolled into its 29 days. Its size is fixed by the number of years.
    """
    dates = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in FESTIVALS])
    festival = F.make_date("y", F.col("f.m"), F.col("f.d"))
    offset = F.sequence(F.lit(-FESTIVAL_REACH), F.lit(FESTIVAL_REACH))
    score = (F.lit(float(FESTIVAL_REACH + 1)) - F.abs("o")) / F.lit(float(FESTIVAL_REACH + 1))
    return (
        spark.range(first_year, last_year + 1)
        .select(F.col("id").cast("int").alias("y"), F.explode(dates).alias("f"))
        .select("y", festival.alias("festival"), F.explode(offset).alias("o"))
        .select("y", F.date_add("festival", F.col("o")).alias("ds"), score.alias("score"))
        .where(F.year("ds") == F.col("y"))
        .groupBy("ds").agg(F.max("score").alias("score"))
    )
