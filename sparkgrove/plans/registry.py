"""What the driver's entry file registers of the engine's own operators."""

from __future__ import annotations

from . import cellqueries, treequeries  # noqa: F401  they register their queries
from .queries import ORACLE, QUERIES, entry

__all__ = ["ORACLE", "QUERIES", "entry"]
