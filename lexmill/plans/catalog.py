"""All queries of the library."""

from __future__ import annotations

from . import graphs, measures, records, sequences, storage, surface, vectors  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
