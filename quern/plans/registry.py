"""Registered queries and their SQL."""

from __future__ import annotations

from quern.plans import curation, pipelines, retrieval
from quern.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curation", "pipelines", "retrieval"]
