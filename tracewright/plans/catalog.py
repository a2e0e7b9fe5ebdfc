"""All queries of the core operators and their SQL twins."""

from __future__ import annotations

from . import aggregates, answers, equivalence, io, ordered, relational, sequences, streams  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
