"""All registered queries."""

from tidewatch.plans import data_queries, detection_queries, forecast_queries, model_queries, policy_queries, stream_queries, summary_queries, topology_queries  # noqa: F401
from tidewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
