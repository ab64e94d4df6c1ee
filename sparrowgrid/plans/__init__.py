"""Registered queries of the engine, by theme."""

from . import catalog, evidence, history, identity, scalars, schedule, state, writes  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
