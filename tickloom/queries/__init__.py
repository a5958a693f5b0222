"""Registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tickloom.queries import backtests, barset, coverage, featureset, labelset, learning, relational
from tickloom.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "backtests", "barset", "coverage", "featureset", "labelset", "learning", "relational"]
