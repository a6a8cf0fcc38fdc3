"""Registered queries over the given tables."""

from . import curation, metrics, plans, scalars, sources  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
