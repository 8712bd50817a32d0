"""Importing this module registers every query."""

from sievekit.plans import (  # noqa: F401
    box_queries,
    document_queries,
    instance_queries,
    log_queries,
    pixel_queries,
    reference_queries,
)
from sievekit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
