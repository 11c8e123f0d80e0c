"""All plans of the package, but for the training-data operators."""

from __future__ import annotations

from tessera.plans import curate, details, directory, dupes, fields, integrate, match, records, search, similar, upkeep, web  # noqa: F401
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
