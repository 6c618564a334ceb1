"""All registered queries."""

from folioscope.plans import activity, evaluation, feeds, ingest, knowledge, network, retrieval, tables, upkeep, workspace  # noqa: F401
from folioscope.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
