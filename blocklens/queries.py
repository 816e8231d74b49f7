"""All queries of the engine; importing the operator modules registers them."""

from __future__ import annotations

from blocklens.operators import encoding, fees, hashing, layout, logs, lookup, objects, series, state, usage  # noqa: F401
from blocklens.registry import QUERIES

__all__ = ["QUERIES"]
