"""Registered queries: the operators applied to the supplied star-schema tables."""

from workload.registry import ORACLES, QUERIES
from workload import core_queries, feature_queries, model_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
