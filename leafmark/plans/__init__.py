"""Registered queries over the given tables; importing this package registers them."""

from . import audit_queries, claim_queries, evaluation_queries, evidence_queries, governance_queries, lecture_queries, node_queries, retrieval_queries, source_queries, speech_queries, summary_queries, text_queries, timeline_queries, tree_queries  # noqa: F401
