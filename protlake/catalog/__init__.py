"""Queries over the given tables, one per operator, with equivalent SQL where SQL can say it."""

from protlake.catalog.registry import ORACLES, QUERIES
from protlake.catalog import labels, metrics, sequences, sources, structures, written  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
