"""All registered queries and oracles."""

from __future__ import annotations

from pubtrack.plans import (  # noqa: F401
    activity, admission, crawl, documents, extraction, generations, lookups, publications, rosters, stored, streams,
)
from pubtrack.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
