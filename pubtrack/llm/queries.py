"""The registered queries of this subpackage."""

from __future__ import annotations

from pubtrack.llm import queries_layout, queries_native, queries_python  # noqa: F401
from pubtrack.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
