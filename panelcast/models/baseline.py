"""Baselines: mean of the last values, and the repeated last season."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.base import Keeping, Read, tail_array


@dataclass(frozen=True)
class Naive(Keeping):
    """Constant forecast: the mean of the last ``window`` values."""

    window: int = 7
    id: str = "naive"
    name: str = "Naive Baseline"

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        tail = tail_array(train, self.window)
        total = F.aggregate("ys", F.lit(0.0), lambda a, x: a + x)
        return {"level": tail.select("series_key", (total / F.size("ys")).alias("yhat"))}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        return future.join(read("level"), "series_key").select("series_key", "step", "ds", "yhat")


@dataclass(frozen=True)
class SeasonalNaive(Keeping):
    """Repeats the last ``season`` values, each at or above 0.

    A series shorter than the season is first continued with its last value.
    """

    season: int = 7
    id: str = "seasonal_naive"
    name: str = "Seasonal Naive"

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        return {"tail": tail_array(train, self.season)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        k, tail = self.season, read("tail")
        slot = F.pmod(F.size("ys") + F.col("step") - 1, F.lit(k)) + 1
        value = F.when(slot <= F.size("ys"), F.element_at("ys", slot.cast("int"))).otherwise(
            F.element_at("ys", -1)
        )
        return future.join(tail, "series_key").select(
            "series_key", "step", "ds", F.greatest(value, F.lit(0.0)).alias("yhat")
        )
