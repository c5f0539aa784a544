"""All conversation and retrieval queries with their DuckDB twins."""

from __future__ import annotations

from . import conversation, records, retrieval, upkeep

QUERIES = dict(sorted((conversation.QUERIES | retrieval.QUERIES | records.QUERIES | upkeep.QUERIES).items()))
SQL = dict(sorted((conversation.SQL | retrieval.SQL | records.SQL | upkeep.SQL).items()))
