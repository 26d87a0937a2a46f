"""Registered queries of the dose operators, with their DuckDB equivalents."""

from .plans import dvh_queries, extra_queries, fill_queries, frame_queries, geometry_queries, plan_queries, sampling_queries, series_queries, source_queries, surface_queries, target_queries
from .shipping import shipped

_PARTS = (dvh_queries, plan_queries, geometry_queries, source_queries, target_queries, extra_queries, frame_queries, surface_queries, sampling_queries, fill_queries, series_queries)
QUERIES = {k: shipped(v) for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}
