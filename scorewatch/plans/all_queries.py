"""Importing the query modules registers them."""

from scorewatch.plans import (  # noqa: F401
    queries_actions,
    queries_core,
    queries_flows,
    queries_models,
    queries_monitor,
    queries_rules,
    queries_text,
)
from scorewatch.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
