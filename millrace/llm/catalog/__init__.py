"""Queries that apply the operators of this folder to the test tables."""

from millrace.llm.catalog import audits, dedup, filters, search, tokens  # noqa: F401
from millrace.llm.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
