"""Parsing of dates written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notations tried after the ISO ones, month first where both readings are possible,
# each with the shape a text must have before the (costlier) parser sees it.
FORMATS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)


def parse_timestamp(text: Column) -> Column:
    """Timestamp of a text; null when it is none."""
    return F.coalesce(
        text.try_cast("timestamp"),
        *[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form)))
          for form, shape in FORMATS],
    )


def as_timestamp(column: Column, dtype: str) -> Column:
    if dtype.startswith("timestamp") or dtype == "date":
        return column.cast("timestamp")
    return parse_timestamp(column.cast("string"))
