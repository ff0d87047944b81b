"""The registered queries of the library proper, and their DuckDB SQL."""

from __future__ import annotations

from docloom.plans import analytics, associations, enrichment, graph_searches, growing, indexing, parsing, retrieval, routing, search_indexes, sections, service

_MODULES = (analytics, enrichment, retrieval, service, indexing, parsing, search_indexes, sections, graph_searches, growing, associations, routing)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: sql for m in _MODULES for k, sql in m.ORACLES.items()}
