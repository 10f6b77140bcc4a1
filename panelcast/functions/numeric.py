"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_or(x: Column, nan: float = 0.0, posinf: float = 0.0, neginf: float = 0.0) -> Column:
    """Replace null, NaN and the infinities by constants."""
    inf = F.lit(float("inf"))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(float(nan)))
        .when(x == inf, F.lit(float(posinf)))
        .when(x == -inf, F.lit(float(neginf)))
        .otherwise(x)
    )


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    low = F.lit(float(low)) if isinstance(low, (int, float)) else low
    high = F.lit(float(high)) if isinstance(high, (int, float)) else high
    return F.least(F.greatest(x, low), high)


def tidy(x: Column, bound: float = 1e15) -> Column:
    """Non-finite and missing values become 0, the rest is clipped to the bound."""
    return clip(finite_or(x.cast("double")), -bound, bound)


def rnd(x: Column, digits: int = 6) -> Column:
    """Round and turn a negative zero into a plain one."""
    return F.round(x, digits) + F.lit(0.0)


def fixed(x: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the number as it is stored. ``%.2f`` rounds the shortest decimal
    that stands for it instead, so 1.005, which lies below that, becomes 1.01."""
    return F.call_function("format_number", x, F.lit(f"0.{'0' * digits}"))


def not_negative(x: Column) -> Column:
    """At least 0; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
