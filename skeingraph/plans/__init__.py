"""Queries over the test tables, each with the SQL that states its result."""

from . import flows, graphs, scoring, store, upkeep  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
