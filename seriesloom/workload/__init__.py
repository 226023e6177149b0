"""All registered queries."""

from seriesloom.workload import catalogue_queries, health_queries, source_queries, state_queries, stream_queries, tone_queries, wave_queries  # noqa: F401
from seriesloom.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
