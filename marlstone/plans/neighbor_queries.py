"""Approximate neighbours through the inverted file, and how much of the exact result it finds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as V
from .registry import query

K, RECALL = 5, 0.95


def _searched(t):
    e = t("embeddings").select("vec_id", "embedding")
    index = V.tuned(V.build_cells(e, "vec_id"), K, RECALL)
    queries = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return e, queries, V.search_cells(index, queries, K, "query_id")


@query("cell_search", "query_id:l vec_id:l score:d rank:l")
def cell_search(t):
    return _searched(t)[2]


@query("cell_recall", "query_id:l k:l hits:l recall:d")
def cell_recall(t):
    e, queries, found = _searched(t)
    return V.recall_at_k(found, V.exact_top_k(queries, e, K, "query_id", "vec_id"), "query_id", "vec_id")
