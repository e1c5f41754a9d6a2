"""Every query of the fundamentals engine, with the SQL that states the same result."""

from __future__ import annotations

from .plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
