"""panelcast: forecasting of large panels of sales series as Spark jobs."""

from panelcast.session import build_session, cut_lineage
from panelcast.spec import REGISTRY, SeriesSpec

__all__ = ["REGISTRY", "SeriesSpec", "build_session", "cut_lineage"]
