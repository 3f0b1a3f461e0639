"""The library's registered queries and the SQL that each is held to."""

from __future__ import annotations

from tidewatch.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
