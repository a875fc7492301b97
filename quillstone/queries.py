"""The registered relational, ingestion and event queries."""

from __future__ import annotations

from quillstone.plans import access, aggregates, events, ingestion, joins, lifecycle, parsing, reads, verdicts, writes  # noqa: F401
from quillstone.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
