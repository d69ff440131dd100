"""Every registered query of the library by name, and its SQL twin where there is one."""

from __future__ import annotations

from corpusloom.plans import curation_queries, graph_queries, more_queries, search_queries, store_queries

PARTS = (search_queries, graph_queries, store_queries, curation_queries, more_queries)
QUERIES = {k: v for m in PARTS for k, v in m.BOOK.queries.items()}
ORACLES = {k: v for m in PARTS for k, v in m.BOOK.oracles.items()}
