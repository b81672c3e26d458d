"""Registered queries: every operator applied to the tables, with SQL where it can say the same."""

from . import aggregate_queries, analysis_queries, join_queries, more_queries, pipeline_queries, rule_queries, scalar_queries, shape_queries, source_queries, stream_queries, window_queries  # noqa: F401
from . import composed_sql  # noqa: F401, I001  (after the queries it is built from)
from .registry import ORACLES, QUERIES
