"""Queries that run the graph's operators over whole tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from paperloom.queries import derivations, linkage, tables  # they register themselves
from paperloom.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "derivations", "linkage", "tables"]
