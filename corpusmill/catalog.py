"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

from corpusmill.plans import q_activity, q_chunking, q_corpus, q_retrieval
from corpusmill.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
FLAGSHIP = "r09_hybrid_retrieve"
