"""Loads every plan module, so that all queries are registered."""

from __future__ import annotations

from quillon.plans import cube, endpoints, features, graph, joins, models, operations, quality, trials, windowing  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
