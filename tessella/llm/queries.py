"""All queries of this subpackage."""

from __future__ import annotations

from tessella.llm import queries_graph, queries_sql, queries_text

QUERIES = {**queries_graph.QUERIES, **queries_sql.QUERIES, **queries_text.QUERIES}
ORACLES = {**queries_sql.ORACLES}
