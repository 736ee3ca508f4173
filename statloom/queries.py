"""All registered queries of the core library."""

from __future__ import annotations

from statloom import queries_data, queries_functions, queries_learning, queries_models, queries_more, queries_structures, queries_text, queries_vectors  # noqa: F401  they register themselves
from statloom.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
