"""Holt–Winters smoothing with additive season, folded inside Spark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.models.base import Keeping, Read, series_arrays


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


@dataclass(frozen=True)
class HoltWinters(Keeping):
    """Level, trend and season with fixed rates.

    The season is the array of the last m seasonal terms, turned by one at each value, so its head
    is always the term of the coming period. A series shorter than two seasons uses a quarter of its
    length as season.
    """

    alpha: float = 0.3
    beta: float = 0.1
    gamma: float = 0.1
    season: int = 7
    id: str = "holt_winters"
    name: str = "Holt-Winters"

    def smoothed(self, train: DataFrame) -> DataFrame:
        """Final level, trend and season per series."""
        a, b, g = self.alpha, self.beta, self.gamma
        n, m = F.col("n"), F.col("m")
        short = n < 2 * self.season
        base = series_arrays(train).withColumn(
            "m", F.when(short, F.greatest(F.lit(2), F.floor(n / 4).cast("int")))
            .otherwise(F.lit(self.season))
        ).where(n >= m)
        base = base.withColumn("l0", _mean(F.slice("ys", F.lit(1), m)))
        second = (_mean(F.slice("ys", m + 1, m)) - F.col("l0")) / m
        base = base.withColumn("t0", F.when(n >= 2 * m, second).otherwise(F.lit(0.0)))
        start = F.struct(
            F.col("l0").alias("l"), F.col("t0").alias("t"),
            F.transform(F.slice("ys", F.lit(1), m), lambda y: y - F.col("l0")).alias("s"),
        )

        def update(state: Column, y: Column) -> Column:
            head = F.element_at(state["s"], 1)
            level = a * (y - head) + (1 - a) * (state["l"] + state["t"])
            trend = b * (level - state["l"]) + (1 - b) * state["t"]
            # The seasonal term is updated against the level before this value.
            term = g * (y - state["l"]) + (1 - g) * head
            turned = F.concat(F.slice(state["s"], F.lit(2), F.size(state["s"]) - 1), F.array(term))
            return F.struct(level.alias("l"), trend.alias("t"), turned.alias("s"))

        return base.select("series_key", "m", F.aggregate("ys", start, update).alias("state"))

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        return {"smoothed": self.smoothed(train)}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        slot = F.pmod(F.col("step") - 1, F.col("m")) + 1
        value = (
            F.col("state.l") + F.col("step") * F.col("state.t")
            + F.element_at(F.col("state.s"), slot.cast("int"))
        )
        return future.join(read("smoothed"), "series_key", "left").select(
            "series_key", "step", "ds",
            F.when(F.col("m").isNotNull(), F.greatest(value, F.lit(0.0))).alias("yhat"),
        )
