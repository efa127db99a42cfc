"""All queries of the engine with their oracles."""

from __future__ import annotations

from .plans import calls, mapped, records, streams  # noqa: F401  they register their queries
from .plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
