"""All queries of the retrieval engine with their SQL."""

from __future__ import annotations

from . import corpus_queries, evaluation_queries, evidence_queries, feed_queries, graph_queries, index_queries, packet_queries, planning_queries, question_queries, retrieval_queries, selection_queries, state_queries, syntax_queries
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus_queries", "evaluation_queries", "evidence_queries", "feed_queries", "graph_queries", "index_queries", "packet_queries", "planning_queries", "question_queries", "retrieval_queries", "selection_queries", "state_queries", "syntax_queries"]
