"""Importing this module fills the registry."""

from stowline.plans import queries_records, queries_refs, queries_resolve, queries_runs  # noqa: F401
from stowline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
