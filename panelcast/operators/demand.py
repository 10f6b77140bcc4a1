"""Expected demand: growth, season, weekend, payday and festival indices of a date.

The product of the indices is the noise-free demand of a category; actual sales divided by it are
deseasonalised sales.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import by_day_of_year
from panelcast.operators.series import by_key

# Fixed values: (month, day) of the festivals of the demand index.
FESTIVALS = (
    (10, 24), (3, 25), (4, 10), (10, 12), (10, 3), (12, 25), (1, 1), (8, 15), (1, 26), (8, 19),
)

PROFILE_SCHEMA = (
    "category string, base double, rate double, amp1 double, phase1 int, amp2 double, phase2 int, "
    "weekend double, payday double, festival double, multiplier double"
)

# Per category the base level, yearly growth, up to two seasonal waves
# (amplitude, day of the year where the wave starts), weekend and payday uplift, and the festival
# boost with its multiplier. The phase of a peak month m is (m - 1) * 30 + 15.
PROFILES = (
    ("pharmacy_daily", 180000.0, 0.12, 0.25, 200, 0.12, 355, 0.08, 0.0, 0.20, 0.8),
    ("electronics_gadgets", 350000.0, 0.18, 0.40, 285, 0.0, 0, 0.22, 0.15, 0.80, 1.5),
    ("grocery_delivery", 120000.0, 0.25, 0.20, 345, 0.0, 0, 0.30, 0.20, 0.50, 1.2),
    ("furniture_decor", 900000.0, 0.14, 0.50, 285, 0.0, 0, 0.0, 0.0, 1.20, 2.0),
    ("luxury_brand", 95000.0, 0.10, 0.35, 315, 0.0, 0, 0.0, 0.18, 0.90, 1.8),
    ("automotive_parts", 240000.0, 0.08, 0.15, 135, 0.0, 0, 0.05, 0.0, 0.0, 1.0),
    ("fashion_apparel", 150000.0, 0.20, 0.30, 135, 0.25, 320, 0.0, 0.0, 0.70, 1.0),
    ("beauty_cosmetics", 80000.0, 0.15, 0.0, 0, 0.0, 0, 0.15, 0.25, 0.0, 1.0),
    ("home_appliances", 420000.0, 0.12, 0.60, 135, 0.0, 0, 0.0, 0.0, 0.50, 1.0),
    ("toys_games", 120000.0, 0.10, 0.40, 345, 0.0, 0, 0.0, 0.0, 1.50, 2.5),
)


def profile_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, PROFILE_SCHEMA)


def _num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def growth_index(ds: Column, start: Column, rate: Column | float = 0.15) -> Column:
    """Compound yearly growth since ``start``."""
    return F.pow(F.lit(1.0) + _num(rate), F.date_diff(ds, start) / F.lit(365.25))


def peak_phase(month: int) -> int:
    return (month - 1) * 30 + 15


def annual_wave(ds: Column, amplitude: Column | float, phase: Column | float) -> Column:
    angle = F.lit(2.0) * F.pi() * (F.dayofyear(ds) - phase) / F.lit(365.25)
    return _num(amplitude) * F.sin(angle)


def annual_index(ds: Column, peak_month: int = 10, amplitude: float = 0.30) -> Column:
    return F.lit(1.0) + annual_wave(ds, amplitude, F.lit(peak_phase(peak_month)))


def weekend_index(ds: Column, boost: Column | float = 0.18) -> Column:
    return F.when(F.weekday(ds) >= 5, F.lit(1.0) + _num(boost)).otherwise(F.lit(1.0))


def payday_index(ds: Column, boost: Column | float = 0.12) -> Column:
    day = F.dayofmonth(ds)
    return F.when((day <= 2) | (day >= 28), F.lit(1.0) + _num(boost)).otherwise(F.lit(1.0))


def pull_of(day: date) -> float:
    """Sum over all festivals of the neighbouring years: full weight within a week, a quarter
    within two."""
    pull = 0.0
    for year in (day.year - 1, day.year, day.year + 1):
        for m, d in FESTIVALS:
            gap = abs((day - date(year, m, d)).days)
            if gap <= 7:
                pull += 1 - gap / 14
            elif gap <= 14:
                pull += 0.25 * (1 - (gap - 7) / 14)
    return pull


def festival_pull(ds: Column) -> Column:
    return by_day_of_year(ds, pull_of)


def festival_index(
    ds: Column, boost: Column | float = 0.60, multiplier: Column | float = 1.0
) -> Column:
    return F.lit(1.0) + _num(boost) * _num(multiplier) * festival_pull(ds)


def expected_demand(ds: Column, start: Column) -> Column:
    """Demand by the profile columns of the row."""
    season = (
        F.lit(1.0)
        + annual_wave(ds, F.col("amp1"), F.col("phase1"))
        + annual_wave(ds, F.col("amp2"), F.col("phase2"))
    )
    return (
        F.col("base")
        * growth_index(ds, start, F.col("rate"))
        * season
        * weekend_index(ds, F.col("weekend"))
        * payday_index(ds, F.col("payday"))
        * festival_index(ds, F.col("festival"), F.col("multiplier"))
    )


def deseasonalise(series: DataFrame, category: str) -> DataFrame:
    """Expected demand of each row and actual over expected.

    The growth clock of a series starts at its own first date. The profile is one row, its numbers
    enter the plan as constants.
    """
    names = [part.split()[0] for part in PROFILE_SCHEMA.split(", ")]
    row = next(p for p in PROFILES if p[0] == category)
    profile = {n: F.lit(v) for n, v in zip(names[1:], row[1:], strict=True)}
    frame = series.withColumn("_start", F.min("ds").over(by_key())).withColumns(profile)
    frame = frame.withColumn("expected", expected_demand(F.col("ds"), F.col("_start")))
    return frame.select(
        "series_key", "ds", "y", "expected",
        F.try_divide(F.col("y"), F.col("expected")).alias("ratio"),
    )
