"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}

for _name in ("cluster_queries", "split_queries", "quota_queries", "chunk_queries", "neighbour_queries", "packing_queries", "leak_queries", "pii_queries"):
    _m = importlib.import_module(f"glossweave.llm.{_name}")
    if clash := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(clash)}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
