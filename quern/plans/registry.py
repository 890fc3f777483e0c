"""All registered queries and their SQL."""

from __future__ import annotations

from quern.plans import audit, gates, graph, parsing, problems, retrieval, selection, temporal, text

_MODULES = (problems, text, temporal, graph, retrieval, gates, parsing, selection, audit)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = "rank_bm25"
