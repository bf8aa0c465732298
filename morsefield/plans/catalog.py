"""Catalogue of named queries and their SQL counterparts."""

from __future__ import annotations

from . import clouds_graphs, diagrams, homology, images, mapper, timeseries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
