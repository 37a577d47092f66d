"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from . import learning, report, scoring  # noqa: F401  they register their queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
