"""All registered queries; importing this package fills the registry."""

from panelcast.workload import (  # noqa: F401
    diagnostic_queries,
    feature_queries,
    model_queries,
    plan_queries,
    score_queries,
    series_queries,
    source_queries,
)
from panelcast.workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
