"""Period arithmetic for the frequencies D, W, MS, QS and YS.

A week carries the date of the Sunday that ends it; months, quarters and years the date they start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = {"MS": 1, "QS": 3, "YS": 12}
_TRUNC = {"MS": "month", "QS": "quarter", "YS": "year"}


def period_of(day: Column, freq: str) -> Column:
    """Label of the period a date falls in."""
    if freq == "D":
        return day
    if freq == "W":
        return F.date_add(F.trunc(day, "week"), 6)
    return F.trunc(day, _TRUNC[freq])


def shift_period(ds: Column, steps: Column | int, freq: str) -> Column:
    """The label ``steps`` periods after ``ds``."""
    steps = F.lit(steps).cast("int") if isinstance(steps, int) else steps.cast("int")
    if freq == "D":
        return F.date_add(ds, steps)
    if freq == "W":
        return F.date_add(ds, steps * 7)
    return F.add_months(ds, steps * _MONTHS[freq])


def step_interval(freq: str) -> Column:
    """Interval between two period labels, for ``sequence``."""
    if freq == "D":
        return F.expr("interval 1 day")
    if freq == "W":
        return F.expr("interval 7 days")
    return F.expr(f"interval {_MONTHS[freq]} months")
