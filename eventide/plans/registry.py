"""Where queries register under their name, each with the oracle's text where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from .adapters import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


def rounded(frame, *columns: str, digits: int = 6):
    """The frame with some columns rounded, as the oracle rounds them."""
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.round(c, digits) for c in columns})
