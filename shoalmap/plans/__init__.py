"""Views over the test tables and the registry of checked queries."""

from shoalmap.plans import (  # noqa: F401
    aggregate_queries,
    join_queries,
    model_queries,
    ranking_queries,
    scalar_queries,
    source_queries,
)
from shoalmap.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
