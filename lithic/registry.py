"""Every query of the core package and its DuckDB twin, by name."""

from __future__ import annotations

from lithic.catalog import ORACLES, QUERIES
from lithic.plans import documents, events, ingest, knowledge, pages, relational, search, state  # noqa: F401  they register their queries

__all__ = ["ORACLES", "QUERIES"]
