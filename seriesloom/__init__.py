"""Ordered-series analytics on Spark DataFrames."""

from seriesloom.plans.series import Series, index_series
from seriesloom.session import build_session

__all__ = ["Series", "index_series", "build_session"]
