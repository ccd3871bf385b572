"""Named queries over the driver's tables and their DuckDB equivalents."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import q_entities, q_events, q_models, q_release, q_space, q_statistics  # noqa: F401  they register their queries
from .q_events import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
