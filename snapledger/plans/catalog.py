"""All queries over the ledger."""

from __future__ import annotations

from snapledger.plans import diffs, files, histories, indexes, planning, streams  # noqa: F401  each registers its queries
from snapledger.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
