"""Query registry: importing this package registers every query."""

from . import decision_queries, distill_queries, job_queries, join_queries, mining_queries, model_queries, neighbor_queries, stream_queries, table_queries, text_queries, window_queries

__all__ = ["decision_queries", "distill_queries", "job_queries", "join_queries", "mining_queries", "model_queries", "neighbor_queries", "stream_queries", "table_queries", "text_queries", "window_queries"]
