"""Wrappers that change what an inner forecaster sees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from panelcast.models.base import Forecaster, Keeping, Read
from panelcast.operators.series import first_difference, integrate_forecast, last_values


@dataclass(frozen=True)
class Differenced(Keeping):
    """Forecasts the period-to-period changes and adds them up.

    The inner forecaster should be able to predict negative changes (``signed=True`` for the
    regressors); only the re-integrated level is kept at or above 0.
    """

    inner: Forecaster
    id: str = "differenced"

    @property
    def name(self) -> str:
        return f"Diff + {self.inner.name}"

    @property
    def pooled(self) -> bool:
        return getattr(self.inner, "pooled", False)

    def state(self, train: DataFrame) -> dict[str, DataFrame]:
        inner = self.inner.state(first_difference(train))
        return {"last": last_values(train), **{f"inner/{k}": v for k, v in inner.items()}}

    def from_state(self, read: Read, future: DataFrame) -> DataFrame:
        changes = self.inner.from_state(lambda name: read(f"inner/{name}"), future)
        return integrate_forecast(changes, read("last"))
