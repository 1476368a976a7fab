"""All queries of the library and their SQL."""

from __future__ import annotations

from . import aggregation, scalars, selection, tables, windows  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
