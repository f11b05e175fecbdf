"""Example queries over the test tables, each with the SQL that checks it."""

from millrace.plans.catalog import audit, inputs, loads, quality, semantics, shape  # noqa: F401
from millrace.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
