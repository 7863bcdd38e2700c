"""All registered queries and their SQL twins."""

from __future__ import annotations

from mentionlake.plans import queries_insight, queries_match, queries_rows, queries_sources, queries_stream

_PARTS = [queries_insight, queries_rows, queries_match, queries_sources, queries_stream]
QUERIES = {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
