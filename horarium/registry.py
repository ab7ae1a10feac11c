"""All registered queries outside the corpus package, with their DuckDB oracle."""

from __future__ import annotations

from .queries.lookups import ORACLE_SQL, QUERIES

FLAGSHIP = "flagship_times_near"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
