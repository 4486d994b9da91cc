"""All core queries and their SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict = {}

for _name in ("skew_queries", "frame_queries", "cluster_queries", "text_queries", "vector_queries", "assembly_queries", "io_queries"):
    _m = importlib.import_module(f"glossweave.plans.{_name}")
    if clash := QUERIES.keys() & _m.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(clash)}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
