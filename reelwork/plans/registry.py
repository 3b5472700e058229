"""All queries on the driver's tables, and their SQL."""

from __future__ import annotations

from reelwork.plans import audits, candidates, compare, crops, files, fingerprints, frames, locks, reviews, segments, shots, tracks, usage  # noqa: F401  they register their queries
from reelwork.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
